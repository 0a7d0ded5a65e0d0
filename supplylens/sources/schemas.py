"""Explicit schemas of the landed formats; fields that aren't listed are never parsed."""

CVSS = "STRUCT<version: STRING, vectorString: STRING, baseScore: DOUBLE>"
METRIC_V5 = f"STRUCT<cvssV3_1: {CVSS}, cvssV3_0: {CVSS}, cvssV4_0: {CVSS}>"
VERSION_V5 = "STRUCT<version: STRING, status: STRING, lessThan: STRING, lessThanOrEqual: STRING, versionType: STRING>"
AFFECTED_V5 = f"STRUCT<vendor: STRING, product: STRING, collectionURL: STRING, packageName: STRING, versions: ARRAY<{VERSION_V5}>, defaultStatus: STRING, cpes: ARRAY<STRING>>"
CONTAINER_V5 = (
    "STRUCT<title: STRING, providerMetadata: STRUCT<orgId: STRING, shortName: STRING>, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>,"
    f" affected: ARRAY<{AFFECTED_V5}>, references: ARRAY<STRUCT<url: STRING, name: STRING, tags: ARRAY<STRING>>>, metrics: ARRAY<{METRIC_V5}>>"
)
CVE_V5 = (
    "STRUCT<cveMetadata: STRUCT<cveId: STRING, state: STRING, dateUpdated: STRING, datePublished: STRING>,"
    f" containers: STRUCT<cna: {CONTAINER_V5}, adp: ARRAY<{CONTAINER_V5}>>>"
)

CPE_MATCH = (
    "STRUCT<vulnerable: BOOLEAN, criteria: STRING, versionStartIncluding: STRING, versionStartExcluding: STRING,"
    " versionEndIncluding: STRING, versionEndExcluding: STRING>"
)


def cpe_node(depth: int) -> str:
    """A configuration node with children to the given depth; schemas cannot recur."""
    inner = f", children: ARRAY<{cpe_node(depth - 1)}>" if depth > 0 else ", children: ARRAY<STRING>"
    return f"STRUCT<operator: STRING, negate: BOOLEAN, cpeMatch: ARRAY<{CPE_MATCH}>{inner}>"


#: Levels below a root that are parsed at once; what lies lower stays text, which is parsed in turn, so often.
NODE_DEPTH, NODE_ROUNDS = 4, 12
CONFIGURATIONS = f"ARRAY<STRUCT<nodes: ARRAY<{cpe_node(NODE_DEPTH)}>>>"
METRIC_NVD = f"STRUCT<source: STRING, type: STRING, cvssData: {CVSS}>"
METRIC_NVD_V2 = f"STRUCT<source: STRING, type: STRING, cvssV2: {CVSS}, cvssData: {CVSS}>"
NVD = (
    "STRUCT<id: STRING, published: STRING, lastModified: STRING, vulnStatus: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>,"
    f" metrics: STRUCT<cvssMetricV31: ARRAY<{METRIC_NVD}>, cvssMetricV30: ARRAY<{METRIC_NVD}>, cvssMetricV40: ARRAY<{METRIC_NVD}>, cvssMetricV2: ARRAY<{METRIC_NVD_V2}>>,"
    f" configurations: {CONFIGURATIONS}, references: ARRAY<STRUCT<url: STRING, source: STRING, tags: ARRAY<STRING>>>,"
    " weaknesses: ARRAY<STRUCT<source: STRING, type: STRING, description: ARRAY<STRUCT<lang: STRING, value: STRING>>>>>"
)
NVD_FEED = f"vulnerabilities ARRAY<STRUCT<cve: {NVD}>>"
NVD_OVERRIDE = (
    "STRUCT<_annotation: STRUCT<cve_id: STRING, description: STRING, modified: STRING, published: STRING, reason: STRING, references: ARRAY<STRING>>,"
    f" cve: STRUCT<configurations: {CONFIGURATIONS}>>"
)

OSV_EVENT = "STRUCT<introduced: STRING, fixed: STRING, last_affected: STRING, `limit`: STRING>"
OSV = (
    "STRUCT<id: STRING, aliases: ARRAY<STRING>, summary: STRING, details: STRING, modified: STRING, published: STRING, withdrawn: STRING,"
    " severity: ARRAY<STRUCT<type: STRING, score: STRING>>,"
    " affected: ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING, purl: STRING>,"
    f" ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<{OSV_EVENT}>>>, versions: ARRAY<STRING>, database_specific: STRING, ecosystem_specific: STRING>>,"
    " references: ARRAY<STRUCT<type: STRING, url: STRING>>, database_specific: STRING>"
)

KEV_ENTRY = "STRUCT<cveID: STRING, vendorProject: STRING, product: STRING, dateAdded: STRING, dueDate: STRING, shortDescription: STRING, requiredAction: STRING, notes: STRING>"
KEV = f"title STRING, catalogVersion STRING, dateReleased STRING, count LONG, vulnerabilities ARRAY<{KEV_ENTRY}>"
EPSS = "STRUCT<model_version: STRING, score_date: STRING, scores: ARRAY<STRUCT<cve: STRING, epss: DOUBLE, percentile: DOUBLE>>>"

SBOM = (
    "STRUCT<spdxVersion: STRING, name: STRING, packages: ARRAY<STRUCT<SPDXID: STRING, name: STRING, versionInfo: STRING, sourceInfo: STRING,"
    " externalRefs: ARRAY<STRUCT<referenceCategory: STRING, referenceType: STRING, referenceLocator: STRING>>>>>"
)
MANIFEST = (
    "STRUCT<mediaType: STRING, manifests: ARRAY<STRUCT<digest: STRING, mediaType: STRING,"
    " platform: STRUCT<os: STRING, architecture: STRING, variant: STRING>>>>"
)
IMAGE_CONFIG = (
    "STRUCT<labels: MAP<STRING, STRING>, layers: ARRAY<STRUCT<size: LONG>>, created: STRING,"
    " config: STRUCT<Labels: MAP<STRING, STRING>, ExposedPorts: MAP<STRING, STRING>, User: STRING>>"
)
RANGE = "struct<range_type:string,introduced:string,introduced_exclusive:boolean,fixed:string,last_affected:string>"
