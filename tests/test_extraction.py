import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.operators import extraction as x

# a small harbour: every file holds one or two forms of naming a topic
HARBOUR = {
    # sends by a literal in a record, and by a call on a template
    "quay/src/Crane.java": """
class Crane {
    void lift(Box box) {
        ProducerRecord<Long, Box> r = new ProducerRecord<>("lifted-boxes", box.id(), box);
        template.publish("crane-moves", box);
    }
}""",
    # a configured key and a subscription to a list of literals
    "quay/src/Gate.java": """
class Gate {
    @Value("${kafka.gate.topic}") String opening;

    void watch() { consumer.subscribe(List.of("trucks", "trains", "barges")); }

    void open(Truck t) { producer.send(opening, t); }
}""",
    # channels by annotation, in a class of their own
    "quay/src/Berths.java": """
interface Berths {
    @Input("ships-in") SubscribableChannel in();
    @Output("ships-out") MessageChannel out();
}""",
    # one listener of two topics, one of a placeholder
    "office/src/Clerk.java": """
class Clerk {
    @KafkaListener(topics = {"manifests", "tariffs"}) void file(String m) { }
    @KafkaListener(topics = "${kafka.office.post}") void read(String m) { }
}""",
    # the stream processor's own channels
    "office/src/Stamp.java": """
class Stamp {
    @StreamListener(Processor.INPUT)
    @SendTo(Processor.OUTPUT)
    String stamp(String paper) { return "ok " + paper; }
}""",
}


@pytest.fixture(scope="module")
def roles_of(files):
    def run(content, path="s/A.java", **options):
        facts = x.topic_facts(files((path, content)), **options).collect()
        out = {}
        for f in facts:
            out.setdefault(f.topic, set()).add(f.role)
        return out

    return run


def test_golden_topics(files):
    facts = x.role_facts(files(*HARBOUR.items())).collect()
    found = {role: {f.topic for f in facts if f.role == role} for role in ("producer", "consumer")}
    assert found["producer"] == {"lifted-boxes", "crane-moves", "${kafka.gate.topic}", "ships-out", "output"}
    assert found["consumer"] == {
        "trucks", "trains", "barges", "ships-in", "manifests", "tariffs", "${kafka.office.post}", "input",
    }


def test_constants_resolve(roles_of):
    got = roles_of(
        """
        class Ledger {
            private static final String PAID = "ledger-paid", CURRENCY = "eur";
            private static final String DUE = "ledger-due";

            void poll() { consumer.subscribe(Arrays.asList(DUE)); }
            void pay(Bill bill) { producer.send(PAID, bill); }
        }
        """
    )
    assert got == {"ledger-paid": {"producer"}, "ledger-due": {"consumer"}}


def test_producer_variants(roles_of):
    got = roles_of(
        """
        kafkaTemplate.send("direct-topic", "m");
        producer.send(new ProducerRecord<>("record-topic", "k", "v"));
        producer.send(CONSTANT_TOPIC);
        producer.send(Message.of(1));
        @SendTo("output-topic")
        eventBus.publish("bus-topic")
        template.convertAndSend("converted")
        @ServiceActivator(outputChannel = "activated")
        @OutboundChannelAdapter(channel = "adapted")
        Supplier<Event> source() {
        private static final String CONSTANT_TOPIC = "constant-topic";
        """
    )
    assert got == {
        t: {"producer"}
        for t in (
            "direct-topic", "record-topic", "constant-topic", "output-topic", "bus-topic",
            "converted", "activated", "adapted", "source",
        )
    }


def test_consumer_variants(roles_of):
    got = roles_of(
        """
        private static final String USER_TOPIC = "user-events";
        private static final String LIST_TOPIC = "listed";
        @KafkaListener(topics = "single-topic")
        @KafkaListener(topics = USER_TOPIC)
        @KafkaListener(topics = { USER_TOPIC, OTHER })
        @StreamListener("input-channel")
        @Input("binding-channel")
        consumer.subscribe(Arrays.asList("subscribed-topic"));
        consumer.subscribe(List.of(LIST_TOPIC));
        @ServiceActivator(inputChannel = "activated")
        @EventListener("heard")
        @RabbitListener(queues = "queue")
        @InboundChannelAdapter(channel = "adapted")
        Consumer<Event> sink() {
        Function<String> change() {
        """
    )
    assert got == {
        t: {"consumer"}
        for t in (
            "user-events", "listed", "single-topic", "OTHER", "input-channel", "binding-channel",
            "subscribed-topic", "activated", "heard", "queue", "adapted", "sink", "change",
        )
    }


def test_generic_patterns_run_on_any_file(roles_of):
    assert roles_of('self.producer.send("orders", 1)', "s/client.py") == {"orders": {"producer"}}
    assert roles_of('@SendTo("a") @KafkaListener(topics = {"b", "c"})', "s/x.kt") == {
        "a": {"producer"}, "b": {"consumer"},
    }


def test_ignored_files_lose_only_spring_patterns(roles_of):
    got = roles_of('@MockBean @RabbitListener(queues = "q") @KafkaListener(topics = "t")')
    assert got == {"t": {"consumer"}}


def test_config_key_context_counts_200_characters(roles_of):
    far, near = "." * 201, "." * 150
    key = '@Value("${kafka.topic.a}")'
    assert roles_of(f"send{far}{key}{far}send") == {"${kafka.topic.a}": {"consumer"}}
    assert roles_of(f"{key}{near}Send") == {"${kafka.topic.a}": {"producer"}}
    two = f"publish{near}{key}{far}{key.replace('.a', '.b')}"
    assert roles_of(two) == {"${kafka.topic.a}": {"producer"}, "${kafka.topic.b}": {"consumer"}}
    assert roles_of('@Value("${other.topic}")') == {}


def test_config_keys_are_wrapped(roles_of):
    assert set(roles_of("kafkaTemplate.send('kafka.a') @KafkaListener(topics = 'x.kafka.y')")) == {
        "${kafka.a}", "${x.kafka.y}", "x.kafka.y",
    }


def test_declared_topics(files, rows):
    got = rows(
        x.declared_topics(
            files(
                (
                    "s/A.java",
                    """private static final String USER_TOPIC = "user-events";
                    @Value("${kafka.notification.topic}")
                    private String notificationTopic;
                    @TopicConfig(name = "audit-events")
                    """,
                ),
                (
                    "s/application.properties",
                    "spring.cloud.stream.bindings.orderOutput.destination=orders\n",
                ),
            )
        ),
        "name", "topic",
    )
    assert got == {
        ("USER_TOPIC", "user-events"),
        ("kafka.notification.topic", "notificationTopic"),
        ("audit-events", "audit-events"),
        ("orderOutput", "orderOutput"),
    }


def test_last_constant_wins(files, rows):
    text = 'private String A = "one"; private String A = "two"; producer.send(A)'
    corpus = files(("s/A.java", text))
    assert rows(x.extract_constants(corpus), "name", "value") == {("A", "two")}
    assert rows(x.role_facts(corpus), "topic") == {("two",)}


def test_location_of_a_match_over_several_lines(files, rows):
    text = 'x\n  new ProducerRecord<>(\n   "t"); producer.send(\n"u")'
    got = rows(x.topic_facts(files(("s/A.java", text))), "pattern", "topic", "line", "col")
    assert ("record", "t", 2, 3) in got
    assert ("send", "u", 3, 10) in got
    assert ("any_send", "u", 3, 18) in got


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet='ab"\n\u0001é😀 ', max_size=30), min_size=1, max_size=8))
def test_positions_equal_python(spark, texts):
    regex = 'a+"?|é\n'
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = sorted(tuple(r) for r in x.locate_matches(df, regex).collect())
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(regex, t):
            before = t[: m.start()]
            line = before.count("\n") + 1
            want.append((str(i), m.group(0), line, m.start() - (before.rfind("\n") + 1) + 1))
    assert got == sorted(want)


def test_user_patterns_and_empty_files(files, rows):
    mine = cat.Pattern("queue", "user", "consumer", r"queue:(\w+)")
    corpus = files(("a.txt", "queue:one queue:two"), ("b.txt", ""), ("c.txt", "nothing"))
    assert rows(x.match_patterns(corpus, [mine]), "path", "topic", "line", "col") == {
        ("a.txt", "one", 1, 1), ("a.txt", "two", 1, 11),
    }
    kept = x.topic_facts(corpus, [mine], keep_files=True)
    assert rows(kept.where(F.col("topic").isNull()), "path") == {("b.txt",), ("c.txt",)}


def test_stream_bindings_need_a_spring_sibling(files, rows):
    config = (
        "spring.cloud.stream.bindings.input-a.destination=in-topic\n"
        'spring.cloud.stream.bindings.myOutput.topic = "out-topic"\n'
        "spring.cloud.stream.bindings.plain.destination=other\n"
    )
    corpus = files(
        ("s/a/App.java", "@SpringBootApplication"), ("s/a/application.properties", config),
        ("s/b/Plain.java", "class Plain {}"), ("s/b/application.properties", config),
    )
    assert rows(x.stream_bindings(corpus), "path", "topic", "role") == {
        ("s/a/application.properties", "in-topic", "consumer"),
        ("s/a/application.properties", "out-topic", "producer"),
        ("s/a/application.properties", "other", None),
    }


def test_resolve_constants_join(files, spark, rows):
    constants = x.extract_constants(files(("a.java", 'private String X = "x1";')))
    uses = spark.createDataFrame([("a.java", "X"), ("b.java", "X")], "path string, token string")
    assert rows(x.resolve_constants(uses, constants), "path", "topic") == {("a.java", "x1"), ("b.java", "X")}
