"""S1, F1-F6, X1-X14, U1."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.operators import extraction as x
from topicloom.operators import files as file_ops
from topicloom.operators import topics
from topicloom.operators.services import assign_files
from topicloom.plans import corpora
from topicloom.plans.corpora import fill, table
from topicloom.plans.registered import shared
from topicloom.plans.registered.base import HITS, MEMBERS, query
from topicloom.session import scratch_path
from topicloom.sources import corpus as corpus_source
from topicloom.sources.corpus import table_corpus

FACTS = ["analyzer", "pattern", "role", "topic", "path", "line", "col"]


@query(
    "s1_scan_corpus",
    """SELECT 'docs/' || source || '/' || doc_id || '.txt' AS path,
              replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content
       FROM documents""",
)
def scan_corpus(spark, sf):
    docs = table(spark, sf, "documents")
    path = fill("docs/<s>/<d>.txt", s="source", d="doc_id")
    return table_corpus(docs.withColumn("path", path), content="text")


_API_SQL = corpora.API.replace("'", "''")


@query(
    "s1_scan_files",
    f"""SELECT 'svc-' || s_suppkey AS service,
               replace(replace('{_API_SQL}', '<k>', s_suppkey::VARCHAR), '<n>', s_nationkey::VARCHAR) || chr(10) AS content
        FROM supplier""",
)
def scan_files(spark, sf):
    """Texts written as files, a folder per service, and read back by the file scan."""
    folder = scratch_path(spark, "files")
    texts = corpora.api_files(table(spark, sf, "supplier"))
    service = F.substring_index("path", "/", 1)
    texts.select(service.alias("service"), F.col("content").alias("value")).write.partitionBy("service").text(folder)
    read = corpus_source.scan_corpus(spark, folder)
    return read.select(F.regexp_extract("path", "^service=([^/]+)/", 1).alias("service"), "content")


# --- file filters ----------------------------------------------------------


def _order_paths(spark, sf):
    folder = corpora.pick("o_orderstatus", {"F": F.lit("src/app"), "O": F.lit("target/app")}, F.lit("src/.hidden"))
    ending = corpora.pick(
        "o_orderpriority",
        {"1-URGENT": F.lit("java"), "2-HIGH": F.lit("JAVA"), "3-MEDIUM": F.lit("md"), "5-LOW": F.lit("class")},
        F.lit("yaml"),
    )
    return table(spark, sf, "orders").select(
        fill("svc-<c>/<f>/O<o>.<e>", c="o_custkey", f=folder, o="o_orderkey", e=ending).alias("path")
    )


@query(
    "f1_filter_source_files",
    """SELECT 'svc-' || o_custkey || '/src/app/O' || o_orderkey || '.' ||
              CASE o_orderpriority WHEN '1-URGENT' THEN 'java' WHEN '2-HIGH' THEN 'JAVA' ELSE 'yaml' END AS path
       FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('3-MEDIUM', '5-LOW')""",
)
def filter_source_files(spark, sf):
    return file_ops.filter_source_files(_order_paths(spark, sf))


@query(
    "f2_filter_test_dirs",
    """SELECT 'svc-' || o_custkey AS service, 'svc-' || o_custkey || '/src/main/O' || o_orderkey || '.java' AS path
       FROM orders WHERE o_orderstatus = 'F'""",
)
def filter_test_dirs(spark, sf):
    folder = corpora.pick("o_orderstatus", {"F": F.lit("src/main"), "O": F.lit("src/test/a")}, F.lit("tests"))
    paths = table(spark, sf, "orders").select(
        fill("svc-<c>/<f>/O<o>.java", c="o_custkey", f=folder, o="o_orderkey").alias("path")
    )
    owned = assign_files(paths, shared.found_services(spark, sf))
    return file_ops.filter_test_dirs(owned).select("service", "path")


@query(
    "f3_filter_messaging_test_paths",
    """SELECT path FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'a/src/main/O' WHEN 'O' THEN 'a/src/test/O'
              ELSE 'a/tests/test_data/O' END || o_orderkey || '.java' AS path, o_orderstatus FROM orders)
       WHERE o_orderstatus <> 'O'""",
)
def filter_messaging_test_paths(spark, sf):
    folder = corpora.pick("o_orderstatus", {"F": F.lit("src/main"), "O": F.lit("src/test")}, F.lit("tests/test_data"))
    paths = table(spark, sf, "orders").select(
        fill("a/<f>/O<o>.java", f=folder, o="o_orderkey").alias("path")
    )
    return file_ops.filter_messaging_test_paths(paths)


def _marked_files(spark, sf):
    """A file per order: status F is a plain test double, O an application, P REST."""
    body = corpora.pick(
        "o_orderstatus",
        {
            "F": fill('  @MockBean Shop shop;\n  @Input("in-<o>") void in() {}\n', o="o_orderkey"),
            "O": F.lit("  @SpringBootApplication class App {}\n"),
        },
        fill('  @GetMapping("/order/<o>") String get() { return "@"; }\n', o="o_orderkey"),
    )
    ending = F.when(F.col("o_orderpriority") == "5-LOW", "kt").otherwise("java")
    return table(spark, sf, "orders").select(
        fill("svc-<c>/O<o>.<e>", c="o_custkey", o="o_orderkey", e=ending).alias("path"),
        F.concat(F.lit("class O {\n"), body, F.lit("}\n")).alias("content"),
    )


@query(
    "f4_ignore_by_content",
    """SELECT 'svc-' || o_custkey || '/O' || o_orderkey || CASE WHEN o_orderpriority = '5-LOW' THEN '.kt' ELSE '.java' END AS path
       FROM orders WHERE o_orderstatus <> 'F'""",
)
def ignore_by_content(spark, sf):
    return file_ops.ignore_by_content(_marked_files(spark, sf)).select("path")


@query(
    "f5_applicable_files",
    """WITH f AS (SELECT 'svc-' || o_custkey || '/O' || o_orderkey ||
                    CASE WHEN o_orderpriority = '5-LOW' THEN '.kt' ELSE '.java' END AS path,
                    o_orderpriority <> '5-LOW' AS java FROM orders)
       SELECT path, 'generic' AS analyzer FROM f
       UNION ALL SELECT path, a FROM f, (VALUES ('java'), ('spring')) v(a) WHERE java""",
)
def applicable_files(spark, sf):
    return file_ops.applicable_files(_marked_files(spark, sf))


@query(
    "f6_filter_topics",
    f"""WITH {MEMBERS} SELECT service, topic, role FROM members
        WHERE (starts_with(topic, 'urgent-') OR starts_with(topic, 'audit-')) AND NOT ends_with(topic, '1')""",
)
def filter_topics(spark, sf):
    return topics.filter_topics(
        shared.members(spark, sf), include=["^urgent-", "^audit-"], exclude=["1$"]
    )


# --- extraction ------------------------------------------------------------


@query("x1_match_patterns", f"WITH {HITS} SELECT {', '.join(FACTS)} FROM hits WHERE NOT starts_with(pattern, 'const_')")
def match_patterns(spark, sf):
    files = corpora.trade_files(spark, sf)
    return x.match_patterns(files, cat.CATALOGUE).select(*FACTS)


@query(
    "x2_locate_matches",
    """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS row,
                         generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
       p AS (SELECT page_id, line, string_split(row, '<p>') AS parts FROM l),
       m AS (SELECT page_id, line, parts, unnest(range(1, len(parts))) AS k FROM p)
       SELECT page_id, CAST(line AS INTEGER) AS line,
              CAST(1 + (k - 1) * 3 + list_sum(list_transform(parts[1:k], lambda s: length(s))) AS INTEGER) AS col
       FROM m""",
)
def locate_matches(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    return x.locate_matches(pages, "<p>").select(F.col("path").alias("page_id"), "line", "col")


@query(
    "x3_producer_patterns",
    f"""WITH {HITS} SELECT {', '.join(FACTS)} FROM hits
        WHERE role = 'producer' AND pattern <> 'const_send'""",
)
def producer_patterns(spark, sf):
    return x.match_patterns(corpora.trade_files(spark, sf), cat.PRODUCERS).select(*FACTS)


@query("x4_consumer_patterns", f"WITH {HITS} SELECT {', '.join(FACTS)} FROM hits WHERE role = 'consumer'")
def consumer_patterns(spark, sf):
    return x.match_patterns(corpora.trade_files(spark, sf), cat.CONSUMERS).select(*FACTS)


@query(
    "x5_split_topic_lists",
    """WITH p AS (SELECT o_orderkey, o_orderstatus, unnest(['order-' || o_orderkey, 'prio-' || substr(o_orderpriority, 1, 1)]) AS q,
                         unnest(['ORDER_' || o_orderkey, 'STATUS_' || o_orderstatus]) AS w FROM orders)
       SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN w ELSE q END AS topic FROM p""",
)
def split_topic_lists(spark, sf):
    token = F.when(
        F.col("o_orderstatus") == "F", fill(" ORDER_<o>,\n STATUS_<s> , ", o="o_orderkey", s="o_orderstatus")
    ).otherwise(
        fill("\"order-<o>\", 'prio-<p>'", o="o_orderkey", p=F.substring("o_orderpriority", 1, 1))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", F.explode(x.split_topic_list(token)).alias("topic")
    )


def _constant_files(spark, sf):
    """Each file declares ORDER twice and PART once; only ORDER and MISSING are used."""
    content = fill(
        'class C {\n  private String ORDER = "early-<o>";\n  private static final String PART = "part-<p>";\n'
        '  private static final String ORDER = "order-<o>";\n'
        "  void a() { producer.send(ORDER, x); template.publish( PART); consumer.subscribe(List.of(ORDER, MISSING)); }\n}\n",
        o="l_orderkey", p="l_partkey",
    )
    return table(spark, sf, "lineitem").select(
        fill("c/<o>x<n>x<p>x<s>.java", o="l_orderkey", n="l_linenumber", p="l_partkey", s="l_suppkey").alias("path"),
        content.alias("content"),
    )


CONST_PATH = "'c/' || l_orderkey || 'x' || l_linenumber || 'x' || l_partkey || 'x' || l_suppkey || '.java' AS path"


@query(
    "x6_extract_constants",
    f"""SELECT DISTINCT {CONST_PATH}, 'ORDER' AS name, 'order-' || l_orderkey AS value FROM lineitem
        UNION SELECT {CONST_PATH}, 'PART', 'part-' || l_partkey FROM lineitem""",
)
def extract_constants(spark, sf):
    return x.extract_constants(_constant_files(spark, sf))


@query(
    "x7_resolve_constants",
    f"""WITH u AS (SELECT DISTINCT {CONST_PATH}, l_orderkey, l_partkey FROM lineitem)
        SELECT path, 'ORDER' AS token, 'order-' || l_orderkey AS topic FROM u
        UNION ALL SELECT path, 'MISSING', 'MISSING' FROM u""",
)
def resolve_constants(spark, sf):
    files = _constant_files(spark, sf)
    listed = [p for p in cat.JAVA_CONSUMERS if p.name == "subscribe_list_of"]
    uses = x.match_patterns(files, listed, locate=False).select("path", "token").distinct()
    return x.resolve_constants(uses, x.extract_constants(files)).select("path", "token", "topic")


@query(
    "x8_normalize_topic",
    """SELECT p_partkey, CASE WHEN p_size <= 10 THEN '${kafka.part.' || p_partkey || '}'
              WHEN p_size <= 20 THEN '${app.kafka.' || p_partkey || '}' WHEN p_size <= 30 THEN '${x.' || p_partkey || '}'
              ELSE 'part ' || p_partkey END AS topic FROM part""",
)
def normalize_topic(spark, sf):
    size = F.col("p_size")
    raw = (
        F.when(size <= 10, fill(" 'kafka.part.<p>'", p="p_partkey"))
        .when(size <= 20, fill("app.kafka.<p>", p="p_partkey"))
        .when(size <= 30, fill('"${x.<p>}"', p="p_partkey"))
        .otherwise(fill(' "part <p>" ', p="p_partkey"))
    )
    return table(spark, sf, "part").select("p_partkey", x.normalize_topic(raw).alias("topic"))


@query(
    "x9_config_topics",
    """SELECT 'c/' || p_partkey || '.java' AS path, '${kafka.topic.part' || p_partkey || '}' AS topic,
              CASE WHEN p_size <= 25 THEN 'producer' ELSE 'consumer' END AS role, 3 AS line, 3 AS col
       FROM part""",
)
def config_topics(spark, sf):
    gap = F.when(F.col("p_size") <= 25, F.repeat(F.lit("."), F.lit(100))).otherwise(
        F.repeat(F.lit("."), F.lit(300))
    )
    files = table(spark, sf, "part").select(
        fill("c/<p>.java", p="p_partkey").alias("path"),
        fill(
            'class C {\n  // publish <g>\n  @Value("${kafka.topic.part<p>}")\n  String t;\n  @Value("${kafka.group}")\n'
            "  String g; // <g> Publish\n}\n",
            p="p_partkey", g=gap,
        ).alias("content"),
    )
    return x.topic_facts(files, []).select("path", "topic", "role", "line", "col")


@query(
    "x10_processor_channels",
    """SELECT path, CASE WHEN o_orderstatus = 'O' THEN 'output' ELSE 'input' END AS topic,
              CASE WHEN o_orderstatus = 'O' THEN 'producer' ELSE 'consumer' END AS role
       FROM (SELECT *, 'p/' || o_orderkey || '.java' AS path FROM orders) WHERE o_orderstatus IN ('F', 'O')""",
)
def processor_channels(spark, sf):
    form = corpora.pick(
        "o_orderstatus",
        {"F": F.lit("@StreamListener(target = Processor.INPUT)"), "O": F.lit("@SendTo(Processor.OUTPUT)")},
        F.lit("Processor.INPUTS"),
    )
    files = table(spark, sf, "orders").select(
        fill("p/<o>.java", o="o_orderkey").alias("path"),
        fill("class P {\n  <f>\n  void p() {}\n}\n", f=form).alias("content"),
    )
    channels = [p for p in cat.CATALOGUE if p.topic]
    return x.match_patterns(files, channels).select("path", "topic", "role")


@query(
    "x11_constant_usage",
    f"""WITH u AS (SELECT {CONST_PATH}, l_orderkey, l_partkey FROM lineitem)
        SELECT path, 'const_send' AS pattern, 'producer' AS role, 'order-' || l_orderkey AS topic, 5 AS line, 14 AS col FROM u
        UNION ALL SELECT path, 'const_send', 'producer', 'part-' || l_partkey, 5, 39 FROM u
        UNION ALL SELECT path, 'const_subscribe', 'consumer', 'order-' || l_orderkey, 5, 64 FROM u""",
)
def constant_usage(spark, sf):
    return x.topic_facts(_constant_files(spark, sf), []).select(
        "path", "pattern", "role", "topic", "line", "col"
    )


@query(
    "x12_declared_topics",
    """WITH f AS (SELECT 'd/' || p_partkey || '.java' AS path, p_partkey FROM part)
       SELECT path, 'PART_TOPIC' AS name, 'part-' || p_partkey AS topic FROM f
       UNION ALL SELECT path, 'kafka.part' || p_partkey || '.topic', 'partTopic' FROM f
       UNION ALL SELECT path, 'b' || p_partkey, 'b' || p_partkey FROM f
       UNION ALL SELECT path, 'n' || p_partkey, 'n' || p_partkey FROM f""",
)
def declared_topics(spark, sf):
    files = table(spark, sf, "part").select(
        fill("d/<p>.java", p="p_partkey").alias("path"),
        fill(
            'class D {\n  public static final String PART_TOPIC = "part-<p>";\n'
            '  @Value("${kafka.part<p>.topic}")\n  private String partTopic;\n'
            '  // spring.cloud.stream.bindings.b<p>.destination=x\n'
            '  @TopicConfig(name = "shop.n<p>.audit")\n}\n',
            p="p_partkey",
        ).alias("content"),
    )
    return x.declared_topics(files)


@query(
    "x13_stream_bindings",
    """WITH c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey),
       f AS (SELECT 'svc-' || c_custkey || '/src/main/java/shop/application.properties' AS path, * FROM c)
       SELECT path, 'output-' || c_custkey AS binding, 'ship-' || c_nationkey AS topic, 'producer' AS role FROM f
       UNION ALL SELECT path, 'input-' || c_custkey, 'bill-' || c_nationkey, 'consumer' FROM f
       UNION ALL SELECT path, 'other', 'misc-' || c_nationkey, NULL FROM f""",
)
def stream_bindings(spark, sf):
    files = corpora.order_files(table(spark, sf, "orders")).union(
        corpora.config_files(table(spark, sf, "customer"))
    )
    return x.stream_bindings(files)


@query(
    "x13_stream_bindings_yaml",
    """WITH c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey),
       f AS (SELECT 'svc-' || c_custkey || '/src/main/java/shop/application.yml' AS path, * FROM c)
       SELECT path, 'output-' || c_custkey AS binding, 'ship-' || c_nationkey AS topic, 'producer' AS role FROM f
       UNION ALL SELECT path, 'input-' || c_custkey, 'bill-' || c_nationkey, 'consumer' FROM f
       UNION ALL SELECT path, 'other', 'misc-' || c_nationkey, NULL FROM f""",
)
def stream_bindings_yaml(spark, sf):
    files = corpora.order_files(table(spark, sf, "orders")).union(corpora.yaml_files(table(spark, sf, "customer")))
    return x.stream_bindings(files)


@query(
    "x13_yaml_settings",
    """WITH f AS (
         SELECT 'svc-' || c_custkey || '/' || d AS path, c_custkey AS k, c_nationkey AS n FROM customer,
           (VALUES ('src/main/java/shop/application.yml'), ('src/main/resources/application.yaml')) v(d)),
       b AS (SELECT *, 'spring.cloud.stream.bindings.' AS p FROM f)
       SELECT path, 'spring.application' AS name, '{name: svc-' || k || '}' AS value FROM f
       UNION ALL SELECT path, p || 'input-' || k || '.group', 'g' || n FROM b
       UNION ALL SELECT path, p || 'input-' || k || '.destination', 'bill-' || n FROM b
       UNION ALL SELECT path, p || 'output-' || k || '.topic', 'ship-' || n FROM b
       UNION ALL SELECT path, p || 'other.destination', 'misc-' || n FROM b
       UNION ALL SELECT path, 'spring.profiles[0]', 'one' FROM f
       UNION ALL SELECT path, 'spring.profiles[1].name', 'two' FROM f
       UNION ALL SELECT path, 'clients.nation-' || n || '.url', 'http://nation-' || n || ':8080/api' FROM f
       UNION ALL SELECT path, 'clients.nation-' || n || '.retries', '3' FROM f
       UNION ALL SELECT path, 'clients.svc-' || k || '.url', 'http://self:8080' FROM f""",
)
def yaml_settings(spark, sf):
    return x.yaml_settings(corpora.yaml_files(table(spark, sf, "customer")))


@query(
    "x14_rest_endpoints",
    """WITH f AS (SELECT 'svc-' || s_suppkey || '/src/main/java/shop/Api.java' AS path, * FROM supplier)
       SELECT path, 'GET' AS method, '/supplier/' || s_suppkey AS endpoint FROM f
       UNION ALL SELECT path, 'POST', '/nation/' || s_nationkey FROM f""",
)
def rest_endpoints(spark, sf):
    return file_ops.rest_endpoints(corpora.api_files(table(spark, sf, "supplier")))


HREF = cat.Pattern("href", "user", "producer", r'href="([^"]+)"', ("href=",))
TOKEN = cat.Pattern("token", "user", None, r'token = "([^"]+)"', ("token = ",))


@query(
    "u1_register_patterns",
    """SELECT url AS path, 'href' AS pattern, topic, count(*) AS n
       FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS topic FROM pages)
       GROUP BY ALL""",
)
def register_patterns(spark, sf):
    pages = table_corpus(table(spark, sf, "pages"), "url", "html")
    return (
        x.match_patterns(pages, [HREF, TOKEN], locate=False)
        .groupBy("path", "pattern", "topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "u1_document_tokens",
    """SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([^"]+)"', 1)) AS token FROM documents""",
)
def document_tokens(spark, sf):
    docs = table_corpus(table(spark, sf, "documents"), "doc_id", "text")
    return x.match_patterns(docs, [TOKEN], locate=False).select(
        F.col("path").alias("doc_id"), "token"
    )
