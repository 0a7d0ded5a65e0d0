"""From vulnerabilities and source packages to advisories, as joins over all of them at once.

Frames: ``affected`` (vuln_id, source, vendor, package_name, ranges, and what else normalisation gives), ``sources``
(source_package, upstream_version, rpm_version), ``mappings`` (rpm_name, vuln_name), ``cpe`` (name, product).

``ranges`` are structs with any of range_type, introduced, introduced_exclusive, fixed and last_affected: :func:`whole_ranges` fills in what is missing, so
hand-made lists and those of ``normalize`` fit alike. Where ranges have a type, it (and for ``ECOSYSTEM`` the column ecosystem) chooses how versions are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from supplylens.functions import append_unique, compare_versions, is_comparable, name_variants, severity_rank, suspicious_jump, version_key
from supplylens.functions.ordering import ORDERS, order_key, order_of
from supplylens.functions.text import strip_version_suffix
from supplylens.operators.intervals import interval_join
from supplylens.operators.lookups import dedupe_first, top_k_per_group
from supplylens.operators.ngrams import build_ngrams, substring_search
from supplylens.sources.shared import materialize, stored

#: A range as the matchers take it; ``order`` names the order of its bounds, null where they have none. Typed ones have range_type in front.
RANGE = "introduced:string,introduced_exclusive:boolean,fixed:string,last_affected:string,order:string"
# Parts of a vendor's name that speak against it unless the package bears them too.
FOREIGN_VENDORS = ("npm", "uuidjs", "tagdiv", "org.")
MAPPED = ("mapping", "direct", "cpe", "pattern")
# Texts of notes.
NOTES = {
    "unknown": "CVE matched by name but no version range data — needs review",
    "version": "Version ",
    "fix": " >= fix ",
    "outside": "Not in affected range",
    "review": "Needs agent review — low-quality range data",
}


def _text(c) -> Column:
    return F.coalesce(c, F.lit(""))


def _fields(df: DataFrame) -> list[str]:
    kind = df.schema["ranges"].dataType
    return kind.elementType.names if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else []


def whole_ranges(df: DataFrame) -> DataFrame:
    """``df`` with ``ranges`` as a list of :data:`RANGE`, whatever fields they had: missing texts are empty, missing flags false, null lists empty. Types stay where there are any."""
    have = _fields(df)
    if "order" in have:
        return df
    typed = "range_type" in have
    text = lambda r, f: _text(r[f]) if f in have else F.lit("")
    ecosystem = F.col("ecosystem") if "ecosystem" in df.columns else None

    def whole(r):
        fields = {"range_type": text(r, "range_type")} if typed else {}
        fields |= {
            "introduced": text(r, "introduced"),
            "introduced_exclusive": F.coalesce(r["introduced_exclusive"], F.lit(False)) if "introduced_exclusive" in have else F.lit(False),
            "fixed": text(r, "fixed"),
            "last_affected": text(r, "last_affected"),
            "order": order_of(r["range_type"], ecosystem) if typed else F.lit("pep440"),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    none = F.array().cast(f"array<struct<{'range_type:string,' if typed else ''}{RANGE}>>")
    return df.withColumn("ranges", F.coalesce(F.transform("ranges", whole), none) if have else none)


def orders_in(df: DataFrame) -> tuple[str, ...]:
    """The orders that the ranges of ``df`` can have: without types only that of PEP 440."""
    return tuple(ORDERS) if "range_type" in _fields(df) else ("pep440",)


def _key(c, r, orders: Sequence[str]) -> Column:
    return version_key(c) if tuple(orders) == ("pep440",) else order_key(c, r["order"])


def keyed_ranges(ranges, orders: Sequence[str] = ("pep440",)) -> Column:
    """Whole ranges with the sort keys of their bounds and whether all bounds can be compared (``ok``), so that each key is worked out once."""
    return F.transform(
        ranges,
        lambda r: F.struct(
            *[r[f].alias(f) for f in ("introduced", "introduced_exclusive", "fixed", "last_affected", "order")],
            _comparable(r).alias("ok"),
            *[_key(r[f], r, orders).alias(k) for f, k in (("introduced", "k_introduced"), ("fixed", "k_fixed"), ("last_affected", "k_last"))],
        ),
    )


def _comparable(r) -> Column:
    return is_comparable(r["fixed"]) & is_comparable(r["introduced"]) & is_comparable(r["last_affected"]) & r["order"].isNotNull()


def comparable_ranges(ranges) -> Column:
    """Ranges of which every bound can be compared."""
    return F.filter(ranges, lambda r: is_comparable(r["fixed"]) & is_comparable(r["introduced"]) & is_comparable(r["last_affected"]))


def _bounded(r) -> Column:
    return ((_text(r["fixed"]) != "") & (_text(r["fixed"]) != "*")) | (_text(r["last_affected"]) != "")


def _open(r) -> Column:
    return (_text(r["introduced"]) != "") & (_text(r["fixed"]) == "") & (_text(r["last_affected"]) == "")


def _quality(kept) -> Column:
    has = lambda kind: F.coalesce(F.exists(kept, kind), F.lit(False))
    return F.when(has(_bounded), "high").when(has(lambda r: _text(r["fixed"]) == "*"), "all_versions").when(has(_open), "low").otherwise("none")


def classify_range_quality(ranges) -> Column:
    """high, all_versions, low or none, from the best kind of comparable range."""
    return _quality(comparable_ranges(ranges))


def is_affected(version, ranges, policy: str = "production", keys: dict[str, Column] | None = None, honor_exclusive: bool = False) -> Column:
    """struct<affected, fixed_version, quality, flags> of a version against the list of :func:`keyed_ranges`; ``keys`` are the version's by order.

    Introductions and last versions are inclusive, fixes exclusive; with ``honor_exclusive`` introductions that are marked so are exclusive. ``production``: the first bounded range that holds the version decides, and if
    there are bounded ranges their "no" is final; then ``*`` (``no-fix-available``), then a reached introduction (``no-fixed-version``). ``union`` puts ``*``
    before the bounded "no"; ``first`` does so too, compares all bounds, takes an introduction of ``0`` as none and reports the first bounded fix with a "no".
    """
    version = F.col(version) if isinstance(version, str) else version
    ranges = F.col(ranges) if isinstance(ranges, str) else ranges
    keys = keys or {"pep440": version_key(version)}

    def key(r):
        if len(keys) == 1:
            return next(iter(keys.values()))
        return F.coalesce(*[F.when(r["order"] == o, k) for o, k in keys.items()])

    def compare(r, bound, k):
        return compare_versions(version, r[bound], key(r), r[k])

    kept = ranges if policy == "first" else F.filter(ranges, lambda r: r["ok"])
    bounded = F.filter(kept, _bounded)

    def inside(r):
        free = r["introduced"].isin("", "0") if policy == "first" else r["introduced"] == ""
        before = F.when(r["fixed"] != "", compare(r, "fixed", "k_fixed") < 0).otherwise(compare(r, "last_affected", "k_last") <= 0)
        return (free | begun(r)) & before

    def begun(r):
        sign = compare(r, "introduced", "k_introduced")
        return F.when(r["introduced_exclusive"], sign > 0).otherwise(sign >= 0) if honor_exclusive else sign >= 0

    hit = F.get(F.filter(bounded, inside), F.lit(0))
    star = F.exists(kept, lambda r: r["fixed"] == "*")
    reached = F.exists(F.filter(kept, _open), begun)
    answer = lambda yes, fixed, quality, *flags: F.struct(
        F.lit(yes).alias("affected"), fixed.alias("fixed_version"), F.lit(quality).alias("quality"), F.array(*map(F.lit, flags)).cast("array<string>").alias("flags")
    )
    none = F.lit("")
    empty = F.when(~F.coalesce(F.size(kept) > 0, F.lit(False)), answer(False, none, "none", *([] if policy == "first" else ["no-ranges"])))
    out = empty.when(hit.isNotNull(), answer(True, _text(hit["fixed"]), "high"))
    no = F.size(bounded) > 0
    if policy == "production":
        out = out.when(no, answer(False, none, "high")).when(star, answer(True, none, "all_versions", "no-fix-available"))
    else:
        first_fix = _text(F.get(bounded, F.lit(0))["fixed"]) if policy == "first" else none
        out = out.when(star, answer(True, none, "all_versions", "no-fix-available")).when(no, answer(False, first_fix, "high"))
    return out.when(reached, answer(True, none, "low", "no-fixed-version")).otherwise(answer(False, none, "none"))


ANSWER = ("affected", "fixed_version", "quality", "flags")
#: Flag on ranges in an order of the vendor's own, which a person should look at.
OWN_ORDER = "vendor-specific-order"


def match_versions(candidates: DataFrame, policy: str = "production", ordered: Sequence[str] | None = None, honor_exclusive: bool = False) -> DataFrame:
    """Add affected, fixed_version, quality and flags to rows with upstream_version and ranges.

    Typed ranges are compared in the order that goes with their type; commits in none. Ranges of type ``custom`` add a flag for review. With
    ``ordered`` only ranges of these types are compared (no type: ""). Flags that the rows bear already go on as ``record_flags``.

    Keys stand in columns of their own, which the optimizer keeps apart because they are used more than once. Where a join multiplies
    rows, :func:`with_range_keys` and :func:`with_version_key` put them there before it.
    """
    orders = [c.removeprefix("__key_") for c in candidates.columns if c.startswith("__key_")]
    rows = candidates if orders else with_version_key(candidates, orders_in(candidates))
    orders = orders or list(orders_in(candidates))
    rows = rows if "__ranges" in rows.columns else with_range_keys(rows, ordered)
    rows = rows.withColumn("__m", is_affected("upstream_version", "__ranges", policy, {o: F.col(f"__key_{o}") for o in orders}, honor_exclusive))
    own = [c for c in rows.columns if not c.startswith("__key_") and c not in ("__ranges", "__m", *ANSWER[:3])]
    out = rows.select(*[F.col(c).alias("record_flags") if c == "flags" else F.col(c) for c in own], "__m.*")
    if "range_type" not in _fields(candidates):
        return out
    vendors = F.exists("ranges", lambda r: F.lower(_text(r["range_type"])) == "custom")
    return out.withColumn("flags", F.when(F.coalesce(vendors, F.lit(False)), append_unique("flags", F.array(F.lit(OWN_ORDER)))).otherwise(F.col("flags")))


def with_range_keys(df: DataFrame, ordered: Sequence[str] | None = None) -> DataFrame:
    orders = orders_in(df)
    rows = whole_ranges(df)
    ranges = F.col("ranges") if ordered is None else F.filter("ranges", lambda r: (r["range_type"] if len(orders) > 1 else F.lit("")).isin(*ordered))
    return rows.withColumn("__ranges", keyed_ranges(ranges, orders))


def with_version_key(df: DataFrame, orders: Sequence[str] = ("pep440",)) -> DataFrame:
    return df.withColumns({f"__key_{o}": order_key("upstream_version", o) for o in orders})


# Names


def pick_first_tier(candidates: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Of each key's candidates those of its lowest tier."""
    w = Window.partitionBy(*keys)
    return candidates.withColumn("__low", F.min(tier).over(w)).filter(F.col(tier) == F.col("__low")).drop("__low")


def resolve_names(sources: DataFrame, index: DataFrame, cpe: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source_package, vuln_name, match_source): names in the index that a source package goes by, from the first tier with any.

    Tiers: reviewed mapping, the name itself, confident variants, CPE product of the name, CPE product of a variant, uncertain variants.
    A mapping without an indexed name falls through.
    """
    names = sources.select("source_package", F.lower("source_package").alias("name")).distinct()
    variants = names.withColumn("v", F.explode(name_variants("name"))).select("source_package", F.col("v.name").alias("name"), F.col("v.kind").alias("kind"))
    confident, uncertain = (variants.filter(F.col("kind") == k).drop("kind") for k in ("confident", "uncertain"))
    through = lambda df, other, on, to: df.join(other.select(F.col(on).alias("name"), F.col(to).alias("__to")).distinct(), "name").select("source_package", F.col("__to").alias("name"))
    tiers = [
        ("mapping", through(names, mappings, "rpm_name", "vuln_name")),
        ("direct", names),
        ("pattern", confident),
        ("cpe", through(names, cpe, "name", "product")),
        ("cpe", through(confident, cpe, "name", "product")),
        ("uncertain", uncertain),
    ]
    every = None
    for i, (kind, df) in enumerate(tiers):
        part = df.select("source_package", F.lower("name").alias("name"), F.lit(i).alias("tier"), F.lit(kind).alias("match_source"))
        every = part if every is None else every.unionByName(part)
    hits = every.join(index.select("name"), "name", "left_semi").distinct()
    best = pick_first_tier(hits, ["source_package"], "tier")
    # One product at most comes from the variants' CPE entries: the first by name.
    w = Window.partitionBy("source_package", "tier").orderBy("name")
    best = best.withColumn("__n", F.row_number().over(w)).filter((F.col("tier") != 4) | (F.col("__n") == 1))
    return best.select("source_package", F.col("name").alias("vuln_name"), "match_source")


def find_affected_rpms(names: DataFrame, mappings: DataFrame, sources: DataFrame) -> DataFrame:
    """(vuln_id, source_package, match_source, matched_name, upstream_version, rpm_version) for the names (vuln_id, vuln_name) of each vulnerability.

    Reverse mapping, then the name itself, then the package's name without its version suffix; names are tried in order and the
    first hit of a package stays. Only packages in ``sources`` count.
    """
    asked = names.select("vuln_id", F.lower("vuln_name").alias("matched_name")).distinct()
    src = sources.withColumn("__lower", F.lower("source_package")).withColumn("__cut", strip_version_suffix(F.lower("source_package")))
    hit = lambda df, tier, kind: df.withColumn("tier", F.lit(tier)).withColumn("match_source", F.lit(kind))
    by_map = asked.join(mappings.select(F.lower("vuln_name").alias("matched_name"), F.col("rpm_name").alias("source_package")).distinct(), "matched_name")
    mapped = hit(by_map.join(src, "source_package"), 0, "mapping")
    direct = hit(asked.join(src, F.col("matched_name") == F.col("source_package")), 1, "direct")
    cut = hit(asked.join(src.filter(F.col("__cut") != F.col("__lower")), F.col("matched_name") == F.col("__cut")), 2, "pattern")
    every = mapped.unionByName(direct).unionByName(cut).drop("__lower", "__cut")
    return dedupe_first(every, ["vuln_id", "source_package"], ["matched_name", "tier"]).drop("tier")


# Vendors


def vendor_fits(vendor, rpm, name) -> Column:
    """Whether a vendor can be the package's: unknown, equal to, or at one end of its name or the other way round; else unless a foreign marker shows."""
    v, r, n = F.lower(_text(vendor)), F.lower(rpm), F.lower(name)
    touches = lambda x: (v == x) | v.startswith(x) | v.endswith(x) | x.startswith(v) | x.endswith(v)
    foreign = F.lit(False)
    for marker in FOREIGN_VENDORS:
        foreign = foreign | (F.contains(v, F.lit(marker)) & ~F.contains(r, F.lit(marker)))
    return (v == "") | touches(r) | touches(n) | ~foreign


def cve_details(affected: DataFrame) -> DataFrame:
    """(vuln_id, name, vendor, ranges): lower-cased names and vendors of each vulnerability with the ranges of each pair, in order of source."""
    rows = whole_ranges(affected).select("vuln_id", F.lower("package_name").alias("name"), F.lower(_text(F.col("vendor"))).alias("vendor"), "source", "ranges")
    grouped = rows.groupBy("vuln_id", "name", "vendor").agg(F.sort_array(F.collect_list(F.struct("source", "ranges"))).alias("r"))
    return grouped.select("vuln_id", "name", "vendor", F.flatten(F.transform("r", lambda x: x["ranges"])).alias("ranges"))


def select_vendor_ranges(candidates: DataFrame, affected: DataFrame, scope: str = "cve") -> DataFrame:
    """Add ``ranges`` to (vuln_id, source_package, matched_name, …): those of the vendors that fit.

    Vendors are those of the matched name. Without any, or when all fit, all ranges count; when none fits, none; else the ranges of the
    fitting ones, or all if these have none. ``scope`` says whether "all" means the whole vulnerability or only the matched name.
    """
    details = cve_details(affected)
    pairs = candidates.select("vuln_id", "source_package", "matched_name").distinct()
    vendors = pairs.join(details.select("vuln_id", F.col("name").alias("matched_name"), F.col("vendor").alias("known")).distinct(), ["vuln_id", "matched_name"], "left")
    vendors = vendors.withColumn("fits", vendor_fits(F.col("known"), F.col("source_package"), F.col("matched_name")))
    verdict = vendors.groupBy("vuln_id", "source_package", "matched_name").agg(
        F.bool_and("fits").alias("all_fit"), F.bool_or("fits").alias("any_fits"), F.max(_text(F.col("known"))).alias("last_vendor"), F.collect_set(F.when(F.col("fits"), F.col("known"))).alias("fitting")
    )
    every = details if scope == "cve" else details.withColumnRenamed("name", "matched_name")
    on = ["vuln_id"] if scope == "cve" else ["vuln_id", "matched_name"]
    listed = every.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*[c for c in every.columns if c not in on]))).alias("entries"))
    out = verdict.join(listed, on, "left")
    all_ranges = F.flatten(F.transform("entries", lambda e: e["ranges"]))
    some = F.flatten(F.transform(F.filter("entries", lambda e: F.array_contains("fitting", e["vendor"])), lambda e: e["ranges"]))
    none = F.filter(all_ranges, lambda r: F.lit(False))
    picked = F.when((F.col("last_vendor") == "") | F.col("all_fit"), all_ranges).when(~F.col("any_fits"), none).when(F.size(some) > 0, some).otherwise(all_ranges)
    return candidates.join(out.select("vuln_id", "source_package", "matched_name", picked.alias("ranges")), ["vuln_id", "source_package", "matched_name"])


def vulns_for_package(names: DataFrame, affected: DataFrame) -> DataFrame:
    """(source_package, vuln_id, matched_name, match_source, ranges) for resolved names, by a simpler vendor rule.

    Where a vulnerability lists several vendors for the name and some of them resembles the package or the name, entries of others are left out.
    """
    rows = whole_ranges(affected).select("vuln_id", F.lower("package_name").alias("vuln_name"), F.lower(_text(F.col("vendor"))).alias("vendor"), "source", "ranges")
    rows = names.join(rows, "vuln_name")
    r, n, v = F.lower("source_package"), F.col("vuln_name"), F.col("vendor")
    like = F.contains(v, r) | F.contains(r, v) | F.contains(v, n) | F.contains(n, v)
    w = Window.partitionBy("source_package", "vuln_id", "vuln_name")
    rows = rows.withColumn("like", like).withColumn("some", F.max(F.col("like") & (v != "")).over(w)).withColumn("vendors", F.size(F.collect_set("vendor").over(w)))
    rows = rows.filter((F.col("vendors") <= 1) | ~F.col("some") | F.col("like"))
    grouped = rows.groupBy("source_package", "vuln_id", F.col("vuln_name").alias("matched_name"), "match_source").agg(F.sort_array(F.collect_list(F.struct("source", "vendor", "ranges"))).alias("r"))
    return grouped.withColumn("ranges", F.flatten(F.transform("r", lambda x: x["ranges"]))).drop("r")


# Decisions


def disposition(matched: DataFrame) -> DataFrame:
    """Add status, confidence and upstream_fixed_version, and complete flags and notes, on rows from :func:`match_versions`.

    Without ranges a match is only detected. Not affected: sure if the ranges are good, with the first real fix. Affected: sure if good; without a
    fix, on weak ranges or through an uncertain name only detected, and also when the fix is suspiciously far ahead.
    """
    matched = whole_ranges(matched)
    quality = _quality(F.filter("ranges", _comparable))
    first_fix = F.get(F.filter("ranges", lambda r: (_text(r["fixed"]) != "") & (r["fixed"] != "*")), F.lit(0))["fixed"]
    unknown = F.array_contains("flags", "no-ranges")
    no = ~F.col("affected")
    fixed = F.when(no & ~unknown & (F.col("fixed_version") == ""), _text(first_fix)).otherwise(F.col("fixed_version"))
    rows = matched.withColumn("range_quality", quality).withColumn("upstream_fixed_version", fixed)
    good, weak = F.col("range_quality") == "high", ~F.col("range_quality").isin("high", "all_versions")
    review = ~F.col("match_source").isin(*MAPPED) | weak
    jump = suspicious_jump("upstream_version", "fixed_version")
    version, fix = F.col("upstream_version"), F.col("upstream_fixed_version")
    return rows.withColumns(
        {
            "status": F.when(unknown, "detected").when(no, "not-affected").when(review | jump | ~good, "detected").otherwise("affected"),
            "confidence": F.when(unknown, "low").when(no, F.when(good, "high").otherwise("medium")).when(review | jump, "low").when(good, "high").otherwise("medium"),
            "flags": F.when(~no & ~review & jump, append_unique("flags", F.array(F.lit("suspicious-version-jump")))).otherwise(F.col("flags")),
            "notes": F.when(unknown, NOTES["unknown"]).when(no & (fix != ""), F.concat(F.lit(NOTES["version"]), version, F.lit(NOTES["fix"]), fix)).when(no, NOTES["outside"]).when(review, NOTES["review"]).otherwise(""),
        }
    )


ADVISORY = ["source_package", "vuln_id", "status", "confidence", "match_source", "upstream_version", "rpm_version", "upstream_fixed_version", "flags", "notes"]


def match_cves(affected: DataFrame, sources: DataFrame, mappings: DataFrame, scope: str = "cve", honor_exclusive: bool = False) -> DataFrame:
    """Advisories for every vulnerability and package: reverse names, vendor's ranges, version, decision."""
    names = affected.select("vuln_id", F.col("package_name").alias("vuln_name")).filter("vuln_name != ''")
    found = find_affected_rpms(names, mappings, sources)
    return disposition(match_versions(select_vendor_ranges(found, affected, scope), honor_exclusive=honor_exclusive)).select(*ADVISORY)


def match_packages(sources: DataFrame, affected: DataFrame, cpe: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advisories, mappings to remember) by resolving each package's names first; of several names for one vulnerability the first counts."""
    index = affected.select(F.lower("package_name").alias("name")).filter("name != ''").distinct()
    names = resolve_names(sources, index, cpe, mappings)
    found = dedupe_first(vulns_for_package(names, affected), ["source_package", "vuln_id"], ["matched_name"])
    adv = disposition(match_versions(found.join(sources, "source_package"))).select(*ADVISORY)
    learned = names.filter(F.col("match_source").isin("pattern", "cpe")).select(F.col("source_package").alias("rpm_name"), "vuln_name", "match_source")
    return adv, learned


def build_vuln_index(affected: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(name, vuln_id, sources, ranges); restricted to some sources, placeholder names ``n/a`` are left out too."""
    rows = whole_ranges(affected).withColumn("name", F.lower("package_name")).filter("name != ''")
    if sources is not None:
        rows = rows.filter(F.col("source").isin(*sources) & (F.col("name") != "n/a"))
    grouped = rows.groupBy("name", "vuln_id").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_list(F.struct("source", "ranges"))).alias("r"))
    return grouped.withColumn("ranges", F.flatten(F.transform("r", lambda x: x["ranges"]))).drop("r")


def _candidate_names(sources: DataFrame, index: DataFrame, cpe: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source_package, upstream_version, vuln_name, rank): all names a package may go by, in the order of the tiers."""
    names = sources.select("source_package", "upstream_version", F.lower("source_package").alias("name")).distinct()
    at = lambda df, rank: df.select("source_package", "upstream_version", F.lower("name").alias("vuln_name"), F.lit(rank).alias("rank"))
    mapped = names.join(mappings.select(F.col("rpm_name").alias("name"), "vuln_name"), "name").drop("name").withColumnRenamed("vuln_name", "name")
    product = names.join(cpe, "name").drop("name").withColumnRenamed("product", "name")
    variants = names.withColumn("v", F.explode(name_variants("name"))).drop("name").withColumn("name", F.col("v.name"))
    every = at(mapped, 0).unionByName(at(names, 1)).unionByName(at(product, 2)).unionByName(at(variants, 3))
    every = every.groupBy("source_package", "upstream_version", "vuln_name").agg(F.min("rank").alias("rank"))
    return every.join(index.select(F.col("name").alias("vuln_name")).distinct(), "vuln_name", "left_semi")


def bulk_match(sources: DataFrame, index: DataFrame, cpe: DataFrame, mappings: DataFrame) -> DataFrame:
    """Prototype rule: affected pairs over the union of all candidate names; low confidence exactly when only an introduction is known."""
    rows = with_version_key(_candidate_names(sources, index, cpe, mappings), orders_in(index)).join(with_range_keys(index).withColumnRenamed("name", "vuln_name"), "vuln_name")
    hit = match_versions(rows, "union").filter("affected")
    hit = hit.withColumn("confidence", F.when(F.array_contains("flags", "no-fixed-version"), "low").otherwise("medium"))
    return dedupe_first(hit, ["source_package", "vuln_id"], ["rank", "vuln_name"]).select("source_package", "vuln_id", "vuln_name", "fixed_version", "confidence")


def bulk_advisories(sources: DataFrame, index: DataFrame, cpe: DataFrame, mappings: DataFrame) -> DataFrame:
    """Generator rule: the first candidate name that lists a vulnerability decides it; entries without ranges are skipped."""
    rows = with_version_key(_candidate_names(sources, index, cpe, mappings), orders_in(index)).join(with_range_keys(index).withColumnRenamed("name", "vuln_name"), "vuln_name")
    first = dedupe_first(rows, ["source_package", "vuln_id"], ["rank", "vuln_name"]).filter(F.size("ranges") > 0)
    out = match_versions(first, "first")
    weak = F.array_contains("flags", "no-fixed-version") | F.array_contains("flags", "no-fix-available")
    return out.select(
        "source_package",
        "vuln_id",
        F.when(F.col("affected"), "detected").otherwise("not-affected").alias("status"),
        F.when(F.col("affected") & weak, "low").otherwise("medium").alias("confidence"),
        F.col("fixed_version").alias("upstream_fixed_version"),
        F.concat(F.lit("name:"), "vuln_name").alias("match_type"),
        "flags",
    )


def enrich_advisories(adv: DataFrame, v: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Add severity (else its type), CVSS score, EPSS score and the KEV flag; unknown ones stay empty."""
    first = F.get("severity", F.lit(0))
    told = v.select(F.col("id").alias("vuln_id"), first["type"].alias("severity"), first["score"].alias("cvss_score"))
    out = adv.join(told, "vuln_id", "left").join(epss.select(F.col("cve_id").alias("vuln_id"), F.col("score").alias("epss")), "vuln_id", "left")
    return out.join(kev.select(F.col("cve_id").alias("vuln_id"), F.lit(True).alias("in_kev")).distinct(), "vuln_id", "left").withColumn("in_kev", F.coalesce("in_kev", F.lit(False)))


def to_osv(adv: DataFrame, prefix: str, ecosystem: str, purl: str) -> DataFrame:
    """(source_package, vuln_id, doc): each advisory as an OSV document in JSON, under ids that begin with ``prefix`` and package URLs that begin with ``purl``.

    Events: introduced 0, then the distribution's or upstream's fix if fixed, or upstream's fix as a limit if affected.
    """
    has = lambda c: _text(F.col(c)) != ""
    fix = F.when(has("distro_fixed_version"), F.col("distro_fixed_version")).when(has("upstream_fixed_version"), F.col("upstream_fixed_version"))
    event = lambda **k: F.struct(*[k.get(n, F.lit(None).cast("string")).alias(n) for n in ("introduced", "fixed", "limit")])
    fixed = F.when((F.col("status") == "fixed") & fix.isNotNull(), event(fixed=fix)).when((F.col("status") == "affected") & has("upstream_fixed_version"), event(limit=F.col("upstream_fixed_version")))
    events = F.filter(F.array(event(introduced=F.lit("0")), fixed), lambda e: e.isNotNull())
    package = F.struct(F.lit(ecosystem).alias("ecosystem"), F.col("source_package").alias("name"), F.concat(F.lit(purl), "source_package").alias("purl"))
    affected = F.struct(package.alias("package"), F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events"))).alias("ranges"))
    doc = F.struct(
        F.concat(F.lit(prefix), "vuln_id").alias("id"),
        F.array("vuln_id").alias("aliases"),
        F.substring(_text(F.col("notes")), 1, 500).alias("summary"),
        F.array(affected).alias("affected"),
        F.struct("status", "confidence", "upstream_version", "rpm_version").alias("database_specific"),
        F.when(has("cvss_score"), F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.col("cvss_score").alias("score")))).alias("severity"),
    )
    return adv.select("source_package", "vuln_id", F.to_json(doc).alias("doc"))


def merge_assessments(candidates: DataFrame, assessments: DataFrame, batch_size: int = 15) -> DataFrame:
    """Candidates with their assessed status: the first ``batch_size`` of a package are reviewed, those without an answer are under review, the others only detected."""
    w = Window.partitionBy("source_package").orderBy("vuln_id")
    rows = candidates.select("source_package", "vuln_id").withColumn("n", F.row_number().over(w))
    told = dedupe_first(assessments, ["source_package", "vuln_id"], ["status", "confidence"]).select("source_package", "vuln_id", "status", "confidence")
    out = rows.join(told, ["source_package", "vuln_id"], "left")
    inside = F.col("n") <= batch_size
    return out.select(
        "source_package",
        "vuln_id",
        F.when(~inside, "detected").otherwise(F.coalesce("status", F.lit("under-review"))).alias("status"),
        F.when(~inside, "low").otherwise(F.coalesce("confidence", F.lit("low"))).alias("confidence"),
    )


def review_delta(adv: DataFrame, results: DataFrame, only_detected: bool = False) -> DataFrame:
    """(source_package, vuln_id, old_status, new_status, confidence, notes) where the assessed status differs from the stored one."""
    rows = adv.filter("status = 'detected'") if only_detected else adv
    new = results.select("source_package", "vuln_id", F.col("status").alias("new_status"), F.col("confidence").alias("new_confidence"), F.col("reasoning").alias("new_notes"))
    hit = rows.select("source_package", "vuln_id", F.col("status").alias("old_status")).join(new, ["source_package", "vuln_id"]).filter("old_status != new_status")
    return hit.select("source_package", "vuln_id", "old_status", "new_status", F.col("new_confidence").alias("confidence"), F.col("new_notes").alias("notes"))


def apply_triage(adv: DataFrame, results: DataFrame) -> DataFrame:
    """Advisories with assessed statuses applied to those that were only detected."""
    delta = review_delta(adv, results, only_detected=True).select("source_package", "vuln_id", F.col("new_status").alias("__s"), F.col("confidence").alias("__c"), F.col("notes").alias("__n"))
    out = adv.join(delta, ["source_package", "vuln_id"], "left")
    for c, n in (("status", "__s"), ("confidence", "__c"), ("notes", "__n")):
        out = out.withColumn(c, F.when(F.col("__s").isNotNull(), F.col(n)).otherwise(F.col(c)))
    return out.select(*adv.columns)


def frequent_vuln_names(affected: DataFrame, min_cves: int = 3, k: int = 3000) -> DataFrame:
    """The ``k`` names with most vulnerabilities among those with at least ``min_cves``."""
    n = affected.withColumn("name", F.lower("package_name")).filter("name != ''").groupBy("name").agg(F.countDistinct("vuln_id").alias("cves"))
    return n.filter(F.col("cves") >= min_cves).orderBy(F.desc("cves"), "name").limit(k)


def unmapped_candidates(sources: DataFrame, affected: DataFrame, descriptions: DataFrame, findings: DataFrame, similar: int = 5) -> DataFrame:
    """Packages known under no name, with evidence: similar names by number of vulnerabilities, description and an example finding.

    Similar names contain the part of the package's name before its first hyphen. They are found by :func:`substring_search`, through the rarest
    gram of each part.
    """
    counts = affected.withColumn("name", F.lower("package_name")).filter("name != ''").groupBy("name").agg(F.countDistinct("vuln_id").alias("cves"))
    names = sources.select("source_package", F.lower("source_package").alias("name")).distinct()
    tries = F.array_distinct(F.array("name", strip_version_suffix("name"), F.when(F.col("name").startswith("lib"), F.substring("name", 4, 1 << 30)).otherwise(F.col("name"))))
    tried = names.withColumn("try", F.explode(tries)).filter("try != ''")
    known = tried.join(counts.select(F.col("name").alias("try")), "try", "left_semi").select("source_package").distinct()
    rows = names.join(known, "source_package", "left_anti").withColumn("part", F.split_part("name", F.lit("-"), F.lit(1)))
    found = substring_search(build_ngrams(counts), rows, "part").select(F.col("needle").alias("part"), F.col("name").alias("similar"))
    # Packages share parts, so each part is searched once and ranked before it goes back to them.
    best = top_k_per_group(found.join(counts.withColumnRenamed("name", "similar"), "similar"), ["part"], [F.desc("cves"), "similar"], similar)
    hits = rows.select("source_package", "part").join(best, "part")
    hits = top_k_per_group(hits.select("source_package", "similar", "cves").distinct(), ["source_package"], [F.desc("cves"), "similar"], similar)
    w = Window.partitionBy("source_package").orderBy(F.desc("cves"), "similar")
    hits = hits.withColumn("n", F.row_number().over(w)).groupBy("source_package").agg(F.sort_array(F.collect_list(F.struct("n", "similar", "cves"))).alias("s"))
    hits = hits.select("source_package", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["similar"], x["cves"].cast("string"))), ",").alias("similar"))
    example = dedupe_first(findings.select(F.lower("package_name").alias("name"), "vuln_id"), ["name"], ["vuln_id"]).withColumnRenamed("vuln_id", "example_cve")
    out = rows.select("source_package", "name").join(hits, "source_package", "left").join(descriptions, "name", "left").join(example, "name", "left")
    return out.select("source_package", F.coalesce("similar", F.lit("")).alias("similar"), F.coalesce("description", F.lit("")).alias("description"), "example_cve")


def source_packages(packages: DataFrame, parsed: Column) -> DataFrame:
    """(source_package, upstream_version, rpm_version, binaries) from packages; ``parsed`` is the struct of :func:`parse_source_rpm`. Of several the first by purl gives the versions."""
    rows = packages.withColumn("__s", parsed)
    grouped = rows.groupBy(F.lower("__s.source").alias("source_package")).agg(
        F.min_by(F.col("__s.version"), F.struct("purl", "version")).alias("upstream_version"), F.min_by("version", F.struct("purl", "version")).alias("rpm_version"), F.sort_array(F.collect_set("name")).alias("binaries")
    )
    return grouped


def _rule_intervals(entries: DataFrame) -> DataFrame:
    """(group, order, entry, seq, fixed, lo, lo_open, hi, hi_closed) of the production rule: bounded ranges, else all versions, else from each introduction on.

    ``entries``: group, entry and ``__ranges`` from :func:`with_range_keys`. Null bounds are open ends.
    """
    kept = F.filter("__ranges", lambda r: r["ok"])
    bounded, star = F.exists(kept, _bounded), F.exists(kept, lambda r: r["fixed"] == "*")
    chosen = F.when(bounded, F.filter(kept, _bounded)).when(star, F.filter(kept, lambda r: r["fixed"] == "*")).otherwise(F.filter(kept, _open))
    rows = entries.withColumn("__all", star & ~bounded).select("group", "entry", "__all", F.posexplode(chosen).alias("seq", "r"))
    has = lambda c: F.col(f"r.{c}") != ""
    below = has("fixed") & (F.col("r.fixed") != "*")
    return rows.select(
        "group",
        F.col("r.order").alias("order"),
        "entry",
        "seq",
        F.when(below, F.col("r.fixed")).otherwise("").alias("fixed"),
        F.when(has("introduced") & ~F.col("__all"), F.col("r.k_introduced")).alias("lo"),
        F.col("r.introduced_exclusive").alias("lo_open"),
        F.when(below, F.col("r.k_fixed")).when(has("last_affected") & ~F.col("__all"), F.col("r.k_last")).alias("hi"),
        (~below & has("last_affected")).alias("hi_closed"),
    )


def affected_versions(versions: DataFrame, entries: DataFrame, honor_exclusive: bool = False) -> DataFrame:
    """(group, upstream_version, entry, fixed_version) where an entry's ranges hold a version of its group, by the production rule.

    ``versions``: group and upstream_version, each once; ``entries``: group, entry (an id) and ranges. What has sort keys goes through :func:`interval_join`: a
    version meets only the ranges that hold it, and no row or task holds all ranges of a group. Versions and bounds without keys, and
    entries that mix orders, are compared pair by pair.
    """
    orders = orders_in(entries)
    keyed = with_range_keys(entries)
    bound = lambda r, c, k: (r[c].isin("", "*")) | r[k].isNotNull()
    sound = F.forall("__ranges", lambda r: ~r["ok"] | (bound(r, "introduced", "k_introduced") & bound(r, "fixed", "k_fixed") & bound(r, "last_affected", "k_last")))
    kinds = F.array_distinct(F.transform(F.filter("__ranges", lambda r: r["ok"]), lambda r: r["order"]))
    keyed = materialize(keyed.withColumns({"__sound": sound & (F.size(kinds) <= 1), "__order": F.coalesce(F.get(kinds, F.lit(0)), F.lit("pep440"))}))
    # A version's key in each order that its group's ranges have.
    used = keyed.filter("__sound").select("group", F.col("__order").alias("order")).distinct()
    points = versions.join(used, "group")
    points = materialize(points.withColumn("key", order_key("upstream_version", "pep440") if orders == ("pep440",) else order_key("upstream_version", F.col("order"))))
    intervals = _rule_intervals(keyed.filter("__sound"))
    if not honor_exclusive:
        intervals = intervals.withColumn("lo_open", F.lit(False))
    held = interval_join(points.filter("key is not null"), intervals, ["group", "order"], "key")
    # The first range that holds the version decides.
    found = held.groupBy("group", "upstream_version", "entry").agg(F.min_by("fixed", "seq").alias("fixed_version"))
    found = found.select("group", "upstream_version", "entry", "fixed_version")
    # What has no key: entries that aren't sound meet all versions of their group, sound ones those that have none in their order.
    if keyed.filter("not __sound").isEmpty() and points.filter("key is null").isEmpty():
        return found
    loose = points.filter("key is null").join(keyed.filter("__sound").withColumnRenamed("__order", "order"), ["group", "order"]).drop("key", "order")
    rest = versions.join(keyed.filter("not __sound").drop("__order"), "group").unionByName(loose, allowMissingColumns=True)
    plain = match_versions(with_version_key(rest, orders), honor_exclusive=honor_exclusive).filter("affected")
    return found.unionByName(plain.select("group", "upstream_version", "entry", "fixed_version"))


#: What tells packages apart in findings.
PACKAGE = ("package_id", "name", "version")
#: Platforms that meet one copy of a package's findings.
PLATFORMS_AT_ONCE = 20_000


def _entries(affected: DataFrame) -> DataFrame:
    """(group, ranges, entry, vuln_ids): each list of ranges of a purl or name once, numbered, with the vulnerabilities that have it."""
    has_purl = F.coalesce("purl", F.lit("")) != ""
    group = F.when(has_purl, F.concat(F.lit("purl "), "purl")).otherwise(F.concat(F.lit("name "), F.lower("package_name")))
    whole = whole_ranges(affected).select(group.alias("group"), "vuln_id", "ranges").filter("group is not null")
    listed = whole.repartition("group", "ranges").groupBy("group", "ranges").agg(F.collect_set(F.struct("vuln_id")).alias("vulns"))
    return stored(listed.select("group", "ranges", F.monotonically_increasing_id().alias("entry"), F.col("vulns.vuln_id").alias("vuln_ids")), "entries")


def _told(entries: DataFrame, v: DataFrame) -> DataFrame:
    """(entry, vuln_ids, severities): the vulnerabilities of each entry in order, and beside each its severity."""
    severity = v.select(F.col("id").alias("vuln_id"), F.get("severity", F.lit(0))["type"].alias("severity"))
    each = entries.select("entry", F.explode("vuln_ids").alias("vuln_id")).join(severity, "vuln_id", "left").repartition("entry")
    listed = each.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("vuln_id", "severity"))).alias("vulns"))
    return listed.select("entry", F.col("vulns.vuln_id").alias("vuln_ids"), F.col("vulns.severity").alias("severities"))


def _found(packages: DataFrame, affected: DataFrame, v: DataFrame, honor_exclusive: bool, keys: Sequence[str]) -> DataFrame:
    """(*keys, vuln_id, severity, fixed_versions) of packages, dealt out by those keys that aren't their name and version.

    Different versions of a name are matched once each with its different lists of ranges (:func:`affected_versions`). Only then a package meets the
    vulnerabilities of the entries that hold its version, and these go to it as lists; they become rows where they are summed up, and no shuffle has a row for each finding.
    """
    entries = _entries(affected)
    names = F.filter(F.array(F.when(F.coalesce("purl", F.lit("")) != "", F.concat(F.lit("purl "), "purl")), F.concat(F.lit("name "), F.lower("name"))), lambda g: g.isNotNull())
    p = packages.select(*keys, F.explode(names).alias("group"))
    versions = p.select("group", F.col("version").alias("upstream_version")).distinct().join(entries.select("group").distinct(), "group", "left_semi")
    held = affected_versions(versions, entries.select("group", "entry", "ranges"), honor_exclusive).withColumnRenamed("upstream_version", "version")
    hit = p.join(held, ["group", "version"]).select(*keys, "entry", "fixed_version").join(_told(entries, v), "entry").drop("entry")
    each = hit.repartition(*[k for k in keys if k not in PACKAGE[1:]]).select(*keys, "fixed_version", F.inline(F.arrays_zip("vuln_ids", "severities")).alias("vuln_id", "severity"))
    fixes = F.array_join(F.sort_array(F.collect_set(F.when(F.col("fixed_version") != "", F.col("fixed_version")))), ", ")
    return each.groupBy(*keys, "vuln_id", "severity").agg(fixes.alias("fixed_versions"))


def scan_packages(packages: DataFrame, affected: DataFrame, v: DataFrame, honor_exclusive: bool = False) -> DataFrame:
    """Findings of packages, wherever they are installed: (package_id, vuln_id, package_name, package_version, fixed_versions, severity), by affected entries of the same purl, else name, that cover a package's version.

    Several fixes are joined by a comma.
    """
    found = _found(packages, affected, v, honor_exclusive, PACKAGE)
    return found.select("package_id", "vuln_id", F.col("name").alias("package_name"), F.col("version").alias("package_version"), "fixed_versions", "severity")


def _dealt(platform_packages: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages of platforms (platform_id, package_id, part), each once, and packages with the same parts, both to be met by package and part.

    A package on very many platforms is there in several parts, so that no task has all its platforms.
    """
    on = platform_packages.select("platform_id", "package_id")
    hot = on.groupBy("package_id").agg(F.ceil(F.count("*") / PLATFORMS_AT_ONCE).alias("__parts")).filter("__parts > 1")
    hot = stored(hot, "hot")
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    on = on.join(F.broadcast(hot), "package_id", "left").select("platform_id", "package_id", F.pmod(F.xxhash64("platform_id"), parts).alias("part"))
    p = packages.join(F.broadcast(hot), "package_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return on.repartition("package_id", "part").distinct(), p


def scan_platforms(platform_packages: DataFrame, packages: DataFrame, affected: DataFrame, v: DataFrame, honor_exclusive: bool = False) -> DataFrame:
    """Findings of platforms, a row each: those of :func:`scan_packages` for every platform that holds the package."""
    on, p = _dealt(platform_packages, packages)
    found = _found(p, affected, v, honor_exclusive, [*PACKAGE, "part"])
    return on.join(found, ["package_id", "part"]).select("platform_id", "vuln_id", F.col("name").alias("package_name"), F.col("version").alias("package_version"), "fixed_versions", "severity")


def list_findings(platform_packages: DataFrame, packages: DataFrame, affected: DataFrame, v: DataFrame, honor_exclusive: bool = False, columns: dict[str, Column] | None = None) -> DataFrame:
    """The findings of :func:`scan_platforms`, all of them, in a row for each package of a platform: ``findings`` is a list of (vuln_id, fixed_versions, severity), sorted.

    A package has the same findings on all platforms, so lists are made before they are spread, and so are ``columns``, expressions over ``findings`` that are wanted in its place.
    """
    on, p = _dealt(platform_packages, packages)
    keys = [*PACKAGE, "part"]
    each = F.sort_array(F.collect_list(F.struct("vuln_id", "fixed_versions", "severity")))
    listed = _found(p, affected, v, honor_exclusive, keys).groupBy(*keys).agg(each.alias("findings"))
    columns = columns or {"findings": F.col("findings")}
    listed = listed.select(*keys, *[c.alias(n) for n, c in columns.items()])
    return on.join(listed, ["package_id", "part"]).select("platform_id", "package_id", F.col("name").alias("package_name"), F.col("version").alias("package_version"), *columns)


def with_severity_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_rank", severity_rank("severity"))
