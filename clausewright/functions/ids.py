"""Deterministic identifiers from built-in hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

#: The name space of URL names in RFC 4122, as a default.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_id(doc: Column, ref: Column, quote: Column, chunk: Column, kind: Column, description: Column) -> Column:
    """REQ- and 12 hex digits of document, reference and quote; without a reference of
    document and quote; without a quote of document, chunk, type and description."""
    norm = lambda c: normalize_text(F.coalesce(c, F.lit("")))
    r, q = norm(ref), norm(quote)
    by_chunk = F.concat_ws(":", doc, F.coalesce(chunk.cast("string"), F.lit("None")), F.coalesce(kind, F.lit("")), norm(description))
    key = F.when((q != "") & (r != ""), F.concat_ws(":", doc, r, q)).when(q != "", F.concat_ws(":", doc, q)).otherwise(by_chunk)
    return F.concat(F.lit("REQ-"), F.substring(F.sha2(key, 256), 1, 12))


def checklist_item_id(ids: Column) -> Column:
    return F.concat(F.lit("CHK-"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 16))


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """RFC 4122 name-based id: SHA-1 of name space and name with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def document_identity(content: Column) -> tuple[Column, Column]:
    """Full hash of a file's bytes and the document id, its first 16 digits."""
    full = F.sha2(content, 256)
    return full, F.substring(full, 1, 16)
