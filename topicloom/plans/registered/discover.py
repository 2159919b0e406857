"""D1-D9, R1-R9."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import relations as r
from topicloom.operators import services as s
from topicloom.operators.extraction import spring_dirs
from topicloom.plans import corpora
from topicloom.plans.corpora import fill, table
from topicloom.plans.registered import shared
from topicloom.plans.registered.base import LANGUAGES, SERVICES, query


@query(
    "d1_detect_services",
    f"""SELECT 'svc-' || c_custkey AS service, 'svc-' || c_custkey AS root_path, {LANGUAGES} AS language,
               'svc-' || c_custkey || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '/pom.xml' WHEN 'BUILDING' THEN '/build.gradle'
                 WHEN 'FURNITURE' THEN '/package.json' WHEN 'HOUSEHOLD' THEN '/setup.py'
                 ELSE '/Svc.' || c_custkey || '.csproj' END AS build_file
        FROM customer""",
)
def detect_services(spark, sf):
    return s.detect_services(corpora.build_files(table(spark, sf, "customer"))).drop("is_stub")


def _named(spark, sf, cases, rest, name):
    """Build files per customer, the market segment picking path and text."""
    values = {"k": "c_custkey", "n": "c_name"}

    def file(entry):
        return F.struct(fill(entry[0], **values).alias("path"), fill(entry[1], **values).alias("content"))

    picked = corpora.pick("c_mktsegment", {k: file(v) for k, v in cases.items()}, file(rest))
    files = table(spark, sf, "customer").select(F.inline(F.array(picked)))
    return files.select("path", name(F.col("path"), F.col("content")).alias("service"))


@query(
    "d2_service_name_java",
    """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'd' || c_custkey || '/pom.xml' WHEN 'BUILDING' THEN 'd' || c_custkey || '/pom.xml'
                WHEN 'FURNITURE' THEN 'd' || c_custkey || '/build.gradle' WHEN 'HOUSEHOLD' THEN 'd' || c_custkey || '/build.gradle.kts'
                ELSE 'd' || c_custkey || '/pom.xml' END AS path,
              CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN c_name ELSE 'd' || c_custkey END AS service
       FROM customer""",
)
def service_name_java(spark, sf):
    pom = "d<k>/pom.xml"
    return _named(
        spark, sf,
        {
            "AUTOMOBILE": (pom, "<project>\n <!-- <artifactId>x</artifactId> -->\n <artifactId><n></artifactId></project>"),
            "BUILDING": (pom, '<project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId><n></artifactId></project>'),
            "FURNITURE": ("d<k>/build.gradle", 'rootProject.name = "<n>"'),
            "HOUSEHOLD": ("d<k>/build.gradle.kts", 'rootProject.name = "<n>"'),
        },
        (pom, "<project><artifactId/><artifactId><n></artifactId></project>"),
        s.java_service_name,
    )


@query(
    "d3_service_name_node",
    """SELECT 'd' || c_custkey || '/package.json' AS path, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN c_name
              ELSE 'd' || c_custkey END AS service FROM customer""",
)
def service_name_node(spark, sf):
    path = "d<k>/package.json"
    return _named(
        spark, sf,
        {
            "AUTOMOBILE": (path, '{"name": "<n>"}'),
            "BUILDING": (path, '{"private": true, "name": "@shop/<n>"}'),
            "FURNITURE": (path, '{"name": ""}'),
            "HOUSEHOLD": (path, '{"name": "<n>", '),
        },
        (path, "{}"),
        s.node_service_name,
    )


@query(
    "d4_service_name_python",
    """SELECT 'd_K' || c_custkey || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '/setup.py' WHEN 'BUILDING' THEN '/setup.py'
                WHEN 'HOUSEHOLD' THEN '/requirements.txt' ELSE '/pyproject.toml' END AS path,
              CASE c_mktsegment WHEN 'AUTOMOBILE' THEN replace(lower(c_name), '#', '') WHEN 'BUILDING' THEN NULL
                WHEN 'FURNITURE' THEN replace(lower(c_name), '#', '') WHEN 'HOUSEHOLD' THEN 'd-k' || c_custkey ELSE NULL END AS service
       FROM customer""",
)
def service_name_python(spark, sf):
    return _named(
        spark, sf,
        {
            "AUTOMOBILE": ("d_K<k>/setup.py", "setup(\n  version='1',\n  name = '<n>',\n)"),
            "BUILDING": ("d_K<k>/setup.py", "setup()\nname = 1"),
            "FURNITURE": ("d_K<k>/pyproject.toml", '[build]\nname = "no"\n[project]\nversion = "1"\nname = "<n>"\n[x]\nname = "y"\n'),
            "HOUSEHOLD": ("d_K<k>/requirements.txt", "pandas\n"),
        },
        ("d_K<k>/pyproject.toml", '[tool]\nname = "<n>"\n'),
        s.python_service_name,
    )


@query(
    "d5_service_name_csharp",
    """SELECT 'd' || c_custkey || '/Big_Shop' || c_custkey || '.csproj' AS path,
              CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN replace(lower(c_name), '#', '')
                   ELSE 'big-shop' || c_custkey END AS service FROM customer""",
)
def service_name_csharp(spark, sf):
    path = "d<k>/Big_Shop<k>.csproj"
    return _named(
        spark, sf,
        {
            "AUTOMOBILE": (path, "<Project><RootNamespace>no</RootNamespace><AssemblyName><n></AssemblyName></Project>"),
            "BUILDING": (path, "<Project><PackageId>no</PackageId><RootNamespace><n></RootNamespace></Project>"),
            "FURNITURE": (path, "<Project><PackageId><n></PackageId></Project>"),
            "HOUSEHOLD": (path, '<Project xmlns="http://x"><AssemblyName><n></AssemblyName></Project>'),
        },
        (path, "<Project/>"),
        s.csharp_service_name,
    )


@query(
    "d6_sanitize_name",
    """SELECT p_partkey, replace(p_name, ' ', '-') || '-' || lower(p_type) || '-big-' || p_size || 'x' AS name FROM part""",
)
def sanitize_name(spark, sf):
    raw = fill("<n>_  <t>_ big_<s>x!", n="p_name", t="p_type", s="p_size")
    return table(spark, sf, "part").select("p_partkey", text.sanitize_name(raw).alias("name"))


@query(
    "d7_assign_files",
    f"""WITH {SERVICES},
        f AS (SELECT 'svc-' || l_suppkey AS service, 'svc-' || l_suppkey || '/src/main/java/shop/Line' || l_orderkey || 'x' || l_linenumber
                     || 'x' || l_partkey || '.java' AS path FROM lineitem
              UNION ALL SELECT 'svc-' || o_custkey, 'svc-' || o_custkey || '/src/main/java/shop/Order' || o_orderkey || '.java' FROM orders)
        SELECT service, path, language FROM f JOIN services USING (service)""",
)
def assign_files(spark, sf):
    paths = corpora.trade_files(spark, sf).select("path")
    owned = s.assign_files(paths, shared.found_services(spark, sf))
    return owned.select("service", "path", "language")


@query(
    "d7_source_files",
    f"""WITH {SERVICES},
        f AS (SELECT 'svc-' || l_suppkey AS service, 'svc-' || l_suppkey || '/src/main/java/shop/Line' || l_orderkey || 'x' || l_linenumber
                     || 'x' || l_partkey || '.java' AS path FROM lineitem)
        SELECT service, path FROM f JOIN services USING (service) WHERE language = 'java'""",
)
def source_files(spark, sf):
    paths = corpora.line_files(table(spark, sf, "lineitem")).select("path")
    return s.source_files(paths, shared.found_services(spark, sf))


@query(
    "d8_upsert_services",
    """SELECT 'svc-' || o_custkey AS service, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS language
       FROM orders GROUP BY o_custkey""",
)
def upsert_services(spark, sf):
    registrations = table(spark, sf, "orders").select(
        fill("svc-<c>", c="o_custkey").alias("service"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("language"),
    )
    return s.upsert_services(registrations, "seq")


@query(
    "d9_camel_to_service",
    """SELECT p_partkey, 'part' || p_partkey || '-' || lower(p_type) || '-client' AS service FROM part""",
)
def camel_to_service(spark, sf):
    name = fill("Part<p><t>Client", p="p_partkey", t=F.initcap(F.lower("p_type")))
    return table(spark, sf, "part").select("p_partkey", s.camel_to_service(name).alias("service"))


# --- relationships ---------------------------------------------------------


def _flat(rows, key=None):
    detail = F.col("details")[key] if key else F.lit(None).cast("string")
    return rows.select("source", "target", "type", detail.alias("detail"))


INJECTION = """SELECT 'svc-' || s_suppkey AS source, t AS target, 'spring-dependency' AS type, 'autowired' AS detail
       FROM supplier, LATERAL (SELECT unnest(['nation' || s_nationkey || '-client-api', 'region-store']) AS t)"""
REST = """SELECT 'svc-' || c_custkey AS source, 'nation-' || c_nationkey AS target, 'rest-client' AS type,
              'http://nation-' || c_nationkey || ':8080/api' AS detail
       FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"""
CLOUD = """SELECT 'svc-' || c_custkey AS source, t AS target, 'spring-cloud' AS type, u AS detail FROM customer,
         LATERAL (SELECT unnest(['nation-' || c_nationkey, 'svc-' || c_custkey]) AS t,
                         unnest(['http://nation-' || c_nationkey || ':8080/api', 'http://self:8080']) AS u)
       WHERE c_mktsegment = 'AUTOMOBILE'"""
NPM = """SELECT 'svc-' || c_custkey AS source, t AS target, 'npm-dependency' AS type, v AS detail FROM customer,
         LATERAL (SELECT unnest(['shop-nation-' || c_nationkey || '-client', 'mock-api']) AS t,
                         unnest(['2.' || c_nationkey || '.0', CAST(c_custkey AS VARCHAR)]) AS v)
       WHERE c_mktsegment = 'FURNITURE'"""
PYTHON = """SELECT 'svc-' || c_custkey AS source, t AS target, 'python-dependency' AS type, CAST(NULL AS VARCHAR) AS detail
       FROM customer, LATERAL (SELECT unnest(['nation-' || c_nationkey || '-api', 'region-client']) AS t)
       WHERE c_mktsegment = 'HOUSEHOLD'"""
BUILDS = f"builds AS ({CLOUD} UNION ALL {NPM} UNION ALL {PYTHON})"


@query("r1_rel_injection", INJECTION)
def rel_injection(spark, sf):
    files = corpora.api_files(table(spark, sf, "supplier"))
    found = r.injections(r.injection_facts(files), shared.found_services(spark, sf))
    return _flat(found, "injection_type")


def _build_corpus(spark, sf):
    customer = table(spark, sf, "customer")
    return corpora.build_files(customer).union(corpora.config_files(customer))


@query("r2_rel_rest_client", REST)
def rel_rest_client(spark, sf):
    configs = corpora.config_files(table(spark, sf, "customer"))
    dirs = spring_dirs(corpora.order_files(table(spark, sf, "orders")))
    return _flat(r.rest_clients(configs, dirs, shared.found_services(spark, sf)), "url")


@query("r3_rel_spring_cloud", CLOUD)
def rel_spring_cloud(spark, sf):
    return _flat(r.spring_cloud(_build_corpus(spark, sf), shared.found_services(spark, sf)), "url")


@query("r2_rel_rest_client_yaml", REST)
def rel_rest_client_yaml(spark, sf):
    configs = corpora.yaml_files(table(spark, sf, "customer"))
    dirs = spring_dirs(corpora.order_files(table(spark, sf, "orders")))
    return _flat(r.rest_clients(configs, dirs, shared.found_services(spark, sf)), "url")


@query("r3_rel_spring_cloud_yaml", CLOUD)
def rel_spring_cloud_yaml(spark, sf):
    customer = table(spark, sf, "customer")
    files = corpora.build_files(customer).union(corpora.yaml_files(customer))
    return _flat(r.spring_cloud(files, shared.found_services(spark, sf)), "url")


@query("r4_rel_npm", NPM)
def rel_npm(spark, sf):
    files = _build_corpus(spark, sf)
    return _flat(r.npm_dependencies(files, shared.found_services(spark, sf)), "version")


@query("r5_rel_python", PYTHON)
def rel_python(spark, sf):
    files = _build_corpus(spark, sf)
    return _flat(r.python_dependencies(files, shared.found_services(spark, sf)))


def _builds(spark, sf):
    return r.build_relationships(_build_corpus(spark, sf), shared.found_services(spark, sf))


@query(
    "r6_stub_services",
    f"""WITH {BUILDS} SELECT target AS service, min(source) AS root_path, 'unknown' AS language FROM builds
        WHERE NOT starts_with(target, 'svc-') GROUP BY target""",
)
def stub_services(spark, sf):
    stubs = r.stub_services(_builds(spark, sf), shared.found_services(spark, sf))
    return stubs.select("service", "root_path", "language")


@query(
    "r7_relationships_of",
    f"WITH {BUILDS} SELECT source, target, type FROM builds WHERE source = 'nation-3' OR target = 'nation-3'",
)
def relationships_of(spark, sf):
    return r.relationships_of(_builds(spark, sf), "nation-3").select("source", "target", "type")


@query("r8_service_dependencies", f"WITH {BUILDS} SELECT DISTINCT target FROM builds WHERE source = 'svc-0'")
def service_dependencies(spark, sf):
    return r.service_dependencies(_builds(spark, sf), "svc-0")


@query("r8_service_dependents", f"WITH {BUILDS} SELECT DISTINCT source FROM builds WHERE target = 'mock-api'")
def service_dependents(spark, sf):
    return r.service_dependents(_builds(spark, sf), "mock-api")


@query(
    "r9_registry_summary",
    f"""WITH {BUILDS} SELECT (SELECT count(*) FROM customer) AS num_services, count(*) AS num_relationships,
               string_agg(DISTINCT type, ',' ORDER BY type) AS relationship_types FROM builds""",
)
def registry_summary(spark, sf):
    return r.registry_summary(shared.found_services(spark, sf), _builds(spark, sf))
