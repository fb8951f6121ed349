"""Identities and hashes: URLs, content, canonical JSON, arm order, hash similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def public_url(url: Column) -> Column:
    """Scheme and host in lower case, port and path kept, credentials, query and fragment gone."""
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    place = F.regexp_replace(F.regexp_extract(url, _URL, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"[\[\]]", ""))
    digits = F.regexp_extract(place, r":0*(\d+)$", 1)
    port = F.when((digits == "") | (digits == "0"), F.lit("")).otherwise(F.concat(F.lit(":"), digits))
    return F.concat(scheme, F.lit("://"), host, port, F.regexp_extract(url, _URL, 3))


def url_identity(url: Column) -> Column:
    return F.sha2(public_url(url), 256)


def is_url(source: Column) -> Column:
    return source.rlike(r"^(?i:https?)://[^/?#]+")


def content_identity(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no blanks; text as it is."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]),
                     {"ignoreNullFields": "false"})


def ascii_json(text: Column) -> Column:
    """Escape every character beyond ASCII as ``\\uXXXX`` (surrogate pairs for the high planes)."""
    def escape(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(c.rlike(r"^[\x00-\x7F]$"), c).otherwise(F.regexp_replace(code, "(.{4})", r"\\u$1"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)), escape), "")


def canonical_sha(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def hash_parity(case_id: Column) -> Column:
    """0 when the first digest byte is even."""
    return F.conv(F.substring(F.sha2(case_id, 256), 1, 2), 16, 10).cast("int") % 2


def first_arm(case_id: Column) -> Column:
    return F.when(hash_parity(case_id) == 0, "control").otherwise("candidate")


def hash_similarity(left: Column, right: Column) -> Column:
    """Share of equal digest bytes of two texts in lower case: a fixed proxy, not meaning."""
    return digest_similarity(text_digest(left), text_digest(right))


def text_digest(content: Column) -> Column:
    return F.sha2(F.lower(content), 256)


def digest_similarity(a: Column, b: Column) -> Column:
    """Share of equal bytes of two digests, compared one by one without a lambda."""
    same = F.lit(0)
    for i in range(32):
        same = same + F.when(F.substring(a, i * 2 + 1, 2) == F.substring(b, i * 2 + 1, 2), 1).otherwise(0)
    return same / F.lit(32.0)
