"""Columns over URLs and hosts: parts, roots, Unicode forms, look-alike normal forms, redirect targets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C

#: scheme, user info, host, path, query. A URL that doesn't match, or has an empty host, is invalid.
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::\d+)?([^?#]*)(\?[^#]*)?"
IDN = r"[^\x00-\x7f]|(^|\.)xn--"
IP = r"^\d{1,3}(\.\d{1,3}){3}$"

# Fixed values. Letters of an alphabet, as character ranges.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽἀ-῿", "armenian": "԰-֏", "hebrew": "֐-׿",
    "arabic": "؀-ۿ", "thai": "฀-๿", "han": "一-鿿", "hangul": "가-힣",
}


def glyph_tables() -> tuple[str, str]:
    """(glyphs, letters) of equal length: beyond ASCII first, then digits and signs."""
    # Fixed values. Glyphs that pass for Latin letters.
    beyond = {"a": "а", "b": "ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ǵ", "h": "һ", "i": "і", "k": "к", "l": "ӏ", "m": "м", "n": "п", "o": "оο", "p": "рρ", "q": "զ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х×", "y": "уү"}
    signs = {"a": "@4", "b": "6", "e": "3", "g": "9", "i": "1!", "o": "0", "s": "5$", "t": "7", "z": "2"}
    pairs = [(g, letter) for table in (beyond, signs) for letter, glyphs in table.items() for g in glyphs]
    return "".join(g for g, _ in pairs), "".join(letter for _, letter in pairs)


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def _to_unicode(label: str) -> str:
    if label.startswith("xn--"):
        try:
            return label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError, OverflowError):
            return label
    return label


def decode_host(host: str | None) -> str | None:
    """The Unicode form of a host; a label that can't be decoded stays as it is."""
    if host is None:
        return None
    host = host.lower().removeprefix("www.")
    return unicodedata.normalize("NFKC", ".".join(_to_unicode(x) for x in host.split("."))).lower()


def encode_host(host: str | None) -> str | None:
    """The ASCII form of a host; a label that can't be encoded stays as it is."""
    if host is None:
        return None
    out = []
    for label in unicodedata.normalize("NFKC", host).lower().split("."):
        out.append(label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii"))
    return ".".join(out)


@F.pandas_udf(T.StringType())
def _unicode_udf(host: pd.Series) -> pd.Series:
    return host.map(decode_host, na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii_udf(host: pd.Series) -> pd.Series:
    return host.map(encode_host, na_action="ignore")


def rare(udf, host: Column) -> Column:
    """Applies a Python function to internationalised hosts only; others pass as they are."""
    return F.coalesce(udf(F.when(host.rlike(IDN), host)), host)


def no_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def sql_list(values) -> str:
    """Strings as a list of SQL literals: long lists are parsed at once, not built literal by literal."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def one_of(name: str, values) -> Column:
    return F.expr(f"{name} IN ({sql_list(values)})")


def root_domain(host: Column | str) -> Column:
    """Registrable domain of a host (column or its name): three labels below a two-level suffix, else the
    last two."""
    if isinstance(host, str):
        return F.expr(root_sql(host))
    last2 = F.substring_index(host, ".", -2)
    return F.when(F.size(F.split(host, r"\.")) <= 2, host).when(F.array_contains(letters(C.TWO_LEVEL_SUFFIXES), last2), F.substring_index(host, ".", -3)).otherwise(last2)


def root_sql(host: str) -> str:
    """The same of an SQL expression."""
    return f"CASE WHEN size(split({host}, '[.]')) <= 2 THEN {host} WHEN substring_index({host}, '.', -2) IN ({sql_list(C.TWO_LEVEL_SUFFIXES)}) THEN substring_index({host}, '.', -3) ELSE substring_index({host}, '.', -2) END"


def host_sql(url: str) -> str:
    """The host, without ``www.``, of an SQL expression that may begin with ``//``."""
    return rf"regexp_replace(lower(regexp_extract(CASE WHEN startswith({url}, '//') THEN concat('https:', {url}) ELSE {url} END, r'{URL}', 3)), r'^www\.', '')"


def below_sql(host: str, names) -> str:
    """Whether a host is one of the names or below one."""
    return f"exists(array({sql_list(names)}), c -> {host} = c OR endswith({host}, concat('.', c)))"


def letters(values) -> Column:
    return F.expr(f"array({sql_list(values)})")


def normal_form(text: Column) -> Column:
    return F.translate(text, *glyph_tables())


def first_of(candidates: Column) -> Column:
    """The first element of an array, null if it has none."""
    return F.try_element_at(candidates, F.lit(1))


def scripts_of(label: Column) -> Column:
    """Alphabets of a label's letters; other signs but digits, hyphen and dot are ``other``."""
    known = "".join(SCRIPTS.values())
    found = [F.when(label.rlike(f"[{r}]"), F.lit(name)) for name, r in SCRIPTS.items()] + [F.when(label.rlike(f"[^0-9.\\-{known}]"), F.lit("other"))]
    return F.array_compact(F.array(*found))


def decoded(value: Column) -> Column:
    """A query value read as form data, then percent-decoded up to twice more."""
    out = F.coalesce(F.try_url_decode(value), value)
    for _ in range(2):
        out = F.when(out.rlike("%[0-9a-fA-F]{2}"), F.coalesce(F.try_url_decode(F.replace(out, F.lit("+"), F.lit("%2B"))), out)).otherwise(out)
    return F.trim(out)


def redirect_target(query: Column, page_root: Column) -> Column:
    """struct(param, target_host, risky) of the first redirect parameter that leaves ``page_root``."""

    def target(pair: Column) -> Column:
        name, raw = F.substring_index(pair, "=", 1), F.regexp_replace(pair, "^[^=]*=?", "")
        value = decoded(raw)
        url = F.when(value.startswith("//"), F.concat(F.lit("https:"), value)).otherwise(value)
        host = no_www(F.lower(url_part(url, 3)))
        good = F.array_contains(letters(C.REDIRECT_PARAMS), F.lower(name)) & url.rlike("(?i)^https?://") & (host != "") & (root_domain(host) != page_root)
        risky = host.rlike(IP) | (url_part(url, 2) != "") | raw.rlike("%[0-9a-fA-F]{2}")
        return F.when(good, F.struct(name.alias("param"), host.alias("target_host"), risky.alias("risky")))

    pairs = F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&")
    return first_of(F.array_compact(F.transform(pairs, target)))
