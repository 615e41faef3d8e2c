"""Text: normalisers, codes, search ranks, URLs, typed envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_key(text: Column) -> Column:
    """Lower case, the letter yo as ye, words of letters and digits sorted and joined."""
    words = F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_join(F.array_sort(words), " ")


def code11(code: Column) -> Column:
    """Digits of a code without dashes and spaces; eight get three zeros behind; else null."""
    plain = F.regexp_replace(code, r"[-\s]", "")
    return F.when(plain.rlike("^[0-9]{8}$"), F.concat(plain, F.lit("000"))).when(plain.rlike("^[0-9]{11}$"), plain)


def bare_name(text: Column, prefix: str, suffix: str) -> Column:
    """Lower-cased, without a leading prefix and a trailing match of suffix."""
    low = F.lower(text)
    low = F.when(low.startswith(prefix), F.substring(low, F.lit(len(prefix) + 1), F.length(low))).otherwise(low)
    return F.trim(F.regexp_replace(low, suffix + "$", ""))


def search_rank(asked: str, key: Column, name: Column, text: Column) -> Column:
    """0: the name or key itself, 1: the name begins so, 2: the name has all words, 3: the text has it; else null."""
    asked = " ".join(asked.lower().split())
    words = F.lit(True)
    for w in asked.split():
        words = words & F.lower(name).contains(w)
    exact = (F.lower(name) == asked) | (key == asked)
    return F.when(exact, 0).when(F.lower(name).startswith(asked), 1).when(words, 2).when(F.lower(text).contains(asked), 3)


def canonical_json(**fields: Column) -> Column:
    """Sorted keys, compact separators."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def surrogate(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar; null counts as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def envelope(kind: Column, payload: Column) -> Column:
    """The text of a base64 payload whose kind is `string`, else null."""
    return F.when(kind == "string", F.decode(F.unbase64(payload), "UTF-8"))


def allowed_url(url: Column, schemes: list[str], hosts: Column | list[str]) -> Column:
    """Whether scheme and host (or its parent) are allowed and there is no user part."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    ok = F.lit(False)
    for h in hosts:
        ok = ok | (host == h) | host.endswith("." + h)
    return F.coalesce(scheme.isin(schemes) & ok & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False))


def reread(text: Column, wrong: str = "cp437", right: str = "cp866") -> Column:
    """Text of one single-byte encoding that was read as another, by translating the upper half."""
    upper = bytes(range(128, 256))
    return F.translate(text, upper.decode(wrong), upper.decode(right))
