"""Source texts rendered from the driver's star-schema tables.

A service is a trading party ``svc-<n>``: supplier n and customer n at once. Each
line item is a file of its supplier that publishes to the order's topic, each
order is a file of its customer that listens to it. The truth about every fact
follows from the base tables by plain joins, without any text.

All corpora are projections (at most a distinct of two keys), so they grow with
the tables and are as parallel as the scans below them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JAVA_DIR = "src/main/java/shop"
URGENT_QUANTITY = 48
ROWS_PER_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a table, however few pieces it is stored in.

    Texts are far larger than the keys they are rendered from, so the narrow rows
    are moved before rendering.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def fill(template: str, **values: Column | str) -> Column:
    """``template`` with each <name> replaced by a column."""
    parts: list[Column] = []
    rest = template
    while rest:
        starts = [(rest.find(f"<{k}>"), k) for k in values if f"<{k}>" in rest]
        if not starts:
            parts.append(F.lit(rest))
            break
        at, key = min(starts)
        if at:
            parts.append(F.lit(rest[:at]))
        value = values[key]
        parts.append((F.col(value) if isinstance(value, str) else value).cast("string"))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def pick(column: str, cases: dict[str, Column], default: Column) -> Column:
    out = default
    for value, result in cases.items():
        out = F.when(F.col(column) == value, result).otherwise(out)
    return out


def rendered(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """(path, content), one text per row. The generator makes the text a value that
    is worked out once; a plain projection would be copied into every later
    predicate and pattern."""
    return rows.select(F.inline(F.array(F.struct(path.alias("path"), content.alias("content")))))


# --- topic uses ------------------------------------------------------------


def line_files(lineitem: DataFrame) -> DataFrame:
    """A producer file per line item; the return flag picks the way of sending."""
    send = pick(
        "l_returnflag",
        {
            "R": fill(
                '    void ship(Event e) {\n        kafkaTemplate.send("order-<o>", e);\n    }\n',
                o="l_orderkey",
            ),
            "A": fill(
                '    private static final String ORDER_TOPIC = "order-<o>";\n\n'
                "    void ship(Event e) {\n        producer.send(ORDER_TOPIC, e);\n    }\n",
                o="l_orderkey",
            ),
        },
        fill(
            "    void ship(Event e) {\n        producer.send(new ProducerRecord<>(\n"
            '            "order-<o>", e));\n    }\n',
            o="l_orderkey",
        ),
    )
    urgent = F.when(
        F.col("l_quantity") >= URGENT_QUANTITY,
        fill('    @SendTo("urgent-<o>")\n    Event urgent(Event e) { return e; }\n', o="l_orderkey"),
    ).otherwise("")
    return rendered(
        spread(lineitem, "l_orderkey", "l_partkey"),
        fill(
            f"svc-<s>/{JAVA_DIR}/Line<o>x<n>x<p>.java",
            s="l_suppkey", o="l_orderkey", n="l_linenumber", p="l_partkey",
        ),
        F.concat(
            F.lit("package shop;\n\npublic class Line {\n"), send, urgent, F.lit("}\n")
        ),
    )


def order_files(orders: DataFrame) -> DataFrame:
    """A consumer file per order; the status picks the way of listening. Open
    orders also listen to one of five audit topics, which are hot."""
    prio = F.substring("o_orderpriority", 1, 1)
    listen = pick(
        "o_orderstatus",
        {
            "F": fill(
                '    @KafkaListener(topics = "order-<o>")\n    void bill(Event e) {}\n', o="o_orderkey"
            ),
            "O": fill(
                "    void open() {\n"
                '        consumer.subscribe(Arrays.asList("order-<o>", "audit-<p>"));\n    }\n',
                o="o_orderkey", p=prio,
            ),
        },
        fill(
            '    private static final String ORDER_TOPIC = "order-<o>";\n\n'
            "    @KafkaListener(topics = ORDER_TOPIC)\n    void bill(Event e) {}\n",
            o="o_orderkey",
        ),
    )
    urgent = fill('    @StreamListener("urgent-<o>")\n    void hurry(Event e) {}\n', o="o_orderkey")
    return rendered(
        spread(orders, "o_orderkey"),
        fill(f"svc-<c>/{JAVA_DIR}/Order<o>.java", c="o_custkey", o="o_orderkey"),
        F.concat(
            F.lit("package shop;\n\npublic class Order {\n"), listen, urgent, F.lit("}\n")
        ),
    )


def trade_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_files(table(spark, sf_dir, "lineitem")).union(
        order_files(table(spark, sf_dir, "orders"))
    )


# --- services --------------------------------------------------------------

POM = (
    "<project><modelVersion>4.0.0</modelVersion><!-- <artifactId>old</artifactId> -->"
    "<artifactId>svc-<k></artifactId><dependencies><dependency>"
    "<groupId>org.springframework.cloud</groupId><artifactId>spring-cloud-starter</artifactId>"
    "</dependency></dependencies></project>"
)
GRADLE = "plugins { id 'java' }\nrootProject.name = 'svc-<k>'\n"
PACKAGE = (
    '{"name": "@shop/svc-<k>", "version": "1.0.0",'
    ' "dependencies": {"@shop/nation-<n>-client": "1.<n>.0", "left-pad": "1.3.0"},'
    ' "devDependencies": {"@shop/nation-<n>-client": "2.<n>.0", "mock-api": "<k>"}}'
)
SETUP = 'from setuptools import setup\n\nsetup(\n    version="0.1",\n    name="Svc_<k>",\n)\n'
PYPROJECT = '[tool.black]\nname = "other"\n'
REQUIREMENTS = "pandas>=2.0\nnation-<n>-api>=1.0\n  region-client\nbilling-service-extra\n"
CSPROJ = "<Project><PropertyGroup><AssemblyName>Svc_<k></AssemblyName></PropertyGroup></Project>"


def build_files(customer: DataFrame) -> DataFrame:
    """Build files per customer; the market segment picks the build system."""

    def file(name: str, text: str) -> Column:
        values = {"k": "c_custkey", "n": "c_nationkey"}
        return F.struct(
            fill(f"svc-<k>/{name}", **values).alias("path"), fill(text, **values).alias("content")
        )

    by_segment = {
        "AUTOMOBILE": F.array(file("pom.xml", POM)),
        "BUILDING": F.array(file("build.gradle", GRADLE)),
        "FURNITURE": F.array(file("package.json", PACKAGE)),
        "HOUSEHOLD": F.array(
            file("pyproject.toml", PYPROJECT),
            file("setup.py", SETUP),
            file("requirements.txt", REQUIREMENTS),
        ),
    }
    return spread(customer, "c_custkey").select(
        F.inline(pick("c_mktsegment", by_segment, F.array(file("Svc.<k>.csproj", CSPROJ))))
    )


CONFIG = (
    "spring.cloud.stream.bindings.output-<k>.destination=ship-<n>\n"
    "spring.cloud.stream.bindings.input-<k>.topic = bill-<n>\n"
    "spring.cloud.stream.bindings.other.destination=misc-<n>\n"
    "nation-<n>.url=http://nation-<n>:8080/api\n"
    "svc-<k>.url=http://self:8080\n"
)


def config_files(customer: DataFrame) -> DataFrame:
    """Configuration per customer, once next to its sources and once in resources."""
    values = {"k": "c_custkey", "n": "c_nationkey"}
    content = fill(CONFIG, **values)
    dirs = (JAVA_DIR, "src/main/resources")
    return spread(customer, "c_custkey").select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        fill(f"svc-<k>/{d}/application.properties", **values).alias("path"),
                        content.alias("content"),
                    )
                    for d in dirs
                ]
            )
        )
    )


YAML_CONFIG = (
    "# settings of <k>\n"
    "spring:\n"
    "  application: {name: svc-<k>}\n"
    "  cloud:\n"
    "    stream:\n"
    "      bindings:\n"
    "        input-<k>:\n"
    "          group: g<n>   # first\n"
    "          destination: 'bill-<n>'\n"
    "        \"output-<k>\":\n"
    "            topic: ship-<n> # to all\n"
    "        other: &shared\n"
    "          destination: \"misc-<n>\"\n"
    "  profiles:\n"
    "  - one\n"
    "  - name: two\n"
    "    url.text: |\n"
    "      destination: not-<n>\n"
    "      url: not-<n>\n"
    "---\n"
    "clients:\n"
    "  nation-<n>:\n"
    "    url: http://nation-<n>:8080/api\n"
    "    retries: 3\n"
    "  svc-<k>:\n"
    "    url: http://self:8080\n"
)


def yaml_files(customer: DataFrame) -> DataFrame:
    """Nested configuration per customer, once next to its sources and once in resources."""
    values = {"k": "c_custkey", "n": "c_nationkey"}
    names = {JAVA_DIR: "application.yml", "src/main/resources": "application.yaml"}
    content = fill(YAML_CONFIG, **values).alias("content")
    made = [F.struct(fill(f"svc-<k>/{d}/{name}", **values).alias("path"), content) for d, name in names.items()]
    return spread(customer, "c_custkey").select(F.inline(F.array(*made)))


API = (
    "package shop;\n\n@RestController\npublic class Api {\n"
    "    @Autowired\n    private Nation<n>ClientApi client;\n"
    '    @Qualifier("svc-<k>")\n    Object self;\n'
    '    @DependsOn("regionStore")\n'
    '    @GetMapping("/supplier/<k>")\n    String get() { return ""; }\n'
    "    @PostMapping('/nation/<n>')\n    void post() {}\n}\n"
)


def api_files(supplier: DataFrame) -> DataFrame:
    values = {"k": "s_suppkey", "n": "s_nationkey"}
    return rendered(
        spread(supplier, "s_suppkey"),
        fill(f"svc-<k>/{JAVA_DIR}/Api.java", **values),
        fill(API, **values),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything a party has: sources, build files, configuration and schemas."""
    customer = table(spark, sf_dir, "customer")
    return (
        trade_files(spark, sf_dir)
        .union(build_files(customer))
        .union(config_files(customer))
        .union(api_files(table(spark, sf_dir, "supplier")))
        .union(party_avsc(party_pairs(table(spark, sf_dir, "lineitem"))))
    )


# --- schemas ---------------------------------------------------------------


def party_pairs(lineitem: DataFrame) -> DataFrame:
    """A row per supplier and part it ships; a task merges ``ROWS_PER_TASK`` rows, however many there are."""
    tasks = math.ceil(lineitem.count() / ROWS_PER_TASK)
    known = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lineitem.select("l_suppkey", "l_partkey").repartition(max(tasks, known), "l_suppkey", "l_partkey").distinct()


def party_avsc(pairs: DataFrame) -> DataFrame:
    """A schema file per supplier and part of ``party_pairs``: parts are shared schemas."""
    values = {"s": "l_suppkey", "p": "l_partkey"}
    text = (
        '{"type": "record", "name": "Part<p>", "namespace": "shop.s<s>",'
        ' "fields": [{"name": "key", "type": "long"}, {"name": "note", "type": ["null", "string"]}]}'
    )
    return rendered(
        pairs,
        fill("svc-<s>/avro/Part<p>.avsc", **values), fill(text, **values)
    )


def part_avsc(part: DataFrame) -> DataFrame:
    """A schema document per part. Some are no records, some no JSON: by size."""
    values = {
        "p": "p_partkey", "b": "p_brand", "t": F.lower("p_type"),
        "open": F.repeat(F.lit('{"type": "array", "items": '), F.col("p_size")),
        "close": F.repeat(F.lit("}"), F.col("p_size")),
    }
    record = (
        '{"type": "record", "name": "Part<p>", "namespace": "shop.<t>", "fields": ['
        '{"name": "id", "type": "string"}, {"name": "stamp", "type": "long"},'
        ' {"name": "data", "type": ["null", "string"]},'
        ' {"name": "size", "type": ["null", "string", "int"]},'
        ' {"name": "tags", "type": {"type": "array", "items": "string"}},'
        ' {"name": "grid", "type": {"items": {"type": "array", "items": ["null", "int"]}, "type": "array"}},'
        ' {"name": "meta", "type": {"type": "record", "name": "Meta<p>", "fields": []}},'
        ' {"name": "deep", "type": <open>"int"<close>},'
        ' {"name": "id", "type": "bytes"}]}'
    )
    other = '{"type": "enum", "name": "Part<p>", "symbols": ["A"]}'
    content = (
        F.when(F.col("p_size") <= 5, fill(other, **values))
        .when(F.col("p_size") <= 10, fill("{ broken <p>", **values))
        .otherwise(fill(record, **values))
    )
    return rendered(
        spread(part, "p_partkey"),
        fill("schemas/<b>/Part<p>.avsc", **values), content
    )


CLASS = (
    "package shop.parts;\n\nimport java.util.List;\n\n/** A { generated; class. */\n"
    "@org.apache.avro.specific.AvroGenerated\npublic class Part<p> extends Base {\n"
    '    private static final String DOC = "a { brace; <b>";\n'
    "    private String name, label;\n    private int size;\n    private List<String> tags;\n"
    "    private java.util.Map<String, Long> counts;\n    private Brand<p>[] brands;\n"
    "    public String getName() { if (size > 1) { String local = name; return local; } return name; }\n"
    "    public void setSize(int size) { this.size = size; }\n"
    "    public void nest() <open>int local;<close>\n    private long total;\n}\n"
)


def class_files(part: DataFrame) -> DataFrame:
    """A generated class per part; the blocks of one method nest as deep as the part's size."""
    values = {
        "p": "p_partkey", "b": "p_brand",
        "open": F.repeat(F.lit("{ "), F.col("p_size")), "close": F.repeat(F.lit(" }"), F.col("p_size")),
    }
    return rendered(
        spread(part, "p_partkey"),
        fill("svc-<p>/src/Part<p>.java", **values),
        fill(CLASS, **values),
    )


def reference_files(part: DataFrame) -> DataFrame:
    """Registry references per part: a call, a numbered URL and a call by URL."""
    values = {"p": "p_partkey", "v": "p_size"}
    text = (
        'class Refs {\n  Object a = schemaRegistry.getSchema("part-<p>");\n'
        '  Object b = schemaRegistry.registerSchema("part-<p>");\n'
        '  Object c = schemaRegistry.getSchema("http://r/part-<p>");\n'
        '  String u = "http://registry:8081/subjects/part-<p>/versions/<v>";\n}\n'
    )
    return rendered(
        spread(part, "p_partkey"),
        fill("svc-<p>/src/Refs.java", **values), fill(text, **values)
    )


def registry_snapshot(part: DataFrame) -> DataFrame:
    """(subject, version, schema): version p_size and the one after it; the later
    one renames a field, retypes another and drops one for large parts."""
    values = {"p": "p_partkey"}
    old = (
        '{"type": "record", "name": "Reg<p>", "namespace": "reg", "fields": ['
        '{"name": "id", "type": "string"}, {"name": "size", "type": "int"},'
        ' {"name": "note", "type": "string"}]}'
    )
    new = (
        '{"type": "record", "name": "Reg<p>", "namespace": "reg", "fields": ['
        '{"name": "id", "type": "string"}, {"name": "size", "type": "long"},'
        ' {"name": "color", "type": ["null", "string"]}<tail>]}'
    )
    tail = F.when(F.col("p_size") > 25, "").otherwise(', {"name": "note", "type": "string"}')
    versions = F.array(
        F.struct(F.col("p_size").alias("version"), fill(old, **values).alias("schema")),
        F.struct(
            (F.col("p_size") + 1).alias("version"), fill(new, tail=tail, **values).alias("schema")
        ),
    )
    return part.select(
        fill("part-<p>", **values).alias("subject"), F.explode(versions).alias("v")
    ).select("subject", "v.version", "v.schema")
