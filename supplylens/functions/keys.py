"""Identifiers, composite keys and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplylens.functions.text import col

#: Seconds from the start of year 1 to the Unix epoch.
YEAR_ONE = 62_135_596_800


def short_id(c) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(col(c).cast("string"), 256), 1, 16)


def platform_key(ident, os, arch, variant=None) -> Column:
    """``id|os/arch`` and ``/variant`` where there is one."""
    key = F.concat(col(ident), F.lit("|"), col(os), F.lit("/"), col(arch))
    if variant is None:
        return key
    v = F.coalesce(col(variant), F.lit(""))
    return F.when(v != "", F.concat(key, F.lit("/"), v)).otherwise(key)


def split_key(c) -> Column:
    """struct<head, tail> at the first ``|``; null where there is none or a part is empty."""
    c = col(c)
    at = F.instr(c, "|")
    return F.when((at > 1) & (at < F.char_length(c)), F.struct(F.substr(c, F.lit(1), at - 1).alias("head"), F.substr(c, at + 1).alias("tail")))


def is_skipped_tag(c) -> Column:
    """Tags that name signatures, attestations, SBOMs or sources instead of images."""
    return col(c).rlike(r"^sha256-|(-source|\.sig|\.att|\.sbom|\.src)$")


def image_ref(c) -> Column:
    """struct<registry, repository, tag> of an image reference; the tag is the digest where there is one.

    A first part without dot, colon or ``localhost`` belongs to the repository; the registry is then docker.io, where
    repositories of one part are below ``library/``.
    """
    c = col(c)
    digest = F.regexp_extract(c, r"@([a-z0-9]+:[0-9a-fA-F]+)$", 1)
    name = F.regexp_replace(c, r"@[a-z0-9]+:[0-9a-fA-F]+$", "")
    tag = F.regexp_extract(name, r":([A-Za-z0-9_][A-Za-z0-9_.-]*)$", 1)
    name = F.regexp_replace(name, r":[A-Za-z0-9_][A-Za-z0-9_.-]*$", "")
    first = F.regexp_extract(name, r"^([^/]+)/", 1)
    hosted = first.rlike(r"[.:]") | (first == "localhost")
    path = F.when(hosted, F.regexp_replace(name, r"^[^/]+/", "")).otherwise(name)
    registry = F.when(hosted, F.when(first == "index.docker.io", "docker.io").otherwise(first)).otherwise("docker.io")
    path = F.when((registry == "docker.io") & ~F.contains(path, F.lit("/")), F.concat(F.lit("library/"), path)).otherwise(path)
    return F.struct(registry.alias("registry"), path.alias("repository"), F.when(digest != "", digest).otherwise(tag).alias("tag"))


def truncate_period(ts, seconds: int) -> Column:
    """Start, in Unix seconds, of the period that holds the time; periods count from year 1."""
    unix = col(ts) if isinstance(ts, Column) or isinstance(ts, str) else F.lit(ts)
    unix = F.unix_seconds(unix) if not isinstance(ts, int) else unix
    since = unix.cast("long") + YEAR_ONE
    return since - F.pmod(since, F.lit(seconds)) - YEAR_ONE


def fnv_bucket(salt, key, n: int) -> Column:
    """FNV-1a (64 bits) of the bytes of ``salt`` and ``key``, as an unsigned number modulo ``n``.

    The hash is kept as two 32-bit halves, so that no product overflows; ``salt`` is binary, ``key`` text; n < 2 ** 31.
    """
    # As Latin-1 text every byte is one character, whose code it is.
    data = F.decode(F.concat(salt, F.encode(col(key), "UTF-8")), "ISO-8859-1")
    steps = F.transform(F.filter(F.split(data, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(h, byte):
        lo = h["lo"].bitwiseXOR(byte)
        # times 2 ** 40 + 0x1B3, modulo 2 ** 64
        product = lo * 0x1B3
        hi = h["hi"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    # Offset basis CBF29CE484222325.
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    half = (1 << 32) % n
    return F.aggregate(steps, start, step, lambda h: F.pmod(F.pmod(h["hi"], F.lit(n)) * half + h["lo"], F.lit(n)))
