"""The pattern catalogue: what a topic use looks like in source text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """One regex and the meaning of its match.

    needles  literals of which every match holds at least one; a cheap substring
             test on them spares the regex on texts that cannot match
    listed   the capture is a comma list of quoted names or identifiers
    topic    a fixed topic, used instead of the capture
    """

    name: str
    analyzer: str
    role: str | None
    regex: str
    needles: tuple[str, ...] = ()
    group: int = 1
    listed: bool = False
    topic: str | None = None
    suffix: str | None = None


def _java(name, role, regex, *needles, listed=False, topic=None, group=1):
    return Pattern(name, "java", role, regex, needles, group, listed, topic, ".java")


def _generic(name, role, regex, *needles):
    return Pattern(name, "generic", role, regex, needles)


def _spring(name, role, regex, *needles):
    return Pattern(name, "spring", role, regex, needles, suffix=".java")


P, C = "producer", "consumer"

# The call and annotation forms that name a topic.
JAVA_PRODUCERS = (
    _java("record", P, r"""new\s+ProducerRecord\s*<[^>]*>\s*\(\s*["']([^"']+)["']""", "ProducerRecord"),
    _java(
        "send",
        P,
        r"""(?:messageProducer|producer|kafkaTemplate|template)\.(?:publish|send)\s*\(\s*["']([^"']+)["']""",
        ".publish",
        ".send",
    ),
    _java("send_to", P, r"""@SendTo\s*\(["']([^"']+)["']""", "@SendTo"),
    _java("output", P, r"""@Output\s*\(["']([^"']+)["']""", "@Output"),
    _java("processor_output", P, r"Processor\.OUTPUT\b", "Processor.OUTPUT", topic="output", group=0),
)
JAVA_CONSUMERS = (
    _java("listener", C, r"""@KafkaListener\s*\(\s*topics\s*=\s*["']([^"']+)["']""", "@KafkaListener", listed=True),
    _java("listener_list", C, r"@KafkaListener\s*\(\s*topics\s*=\s*\{([^}]+)\}", "@KafkaListener", listed=True),
    _java("stream_listener", C, r"""@StreamListener\s*\(["']([^"']+)["']""", "@StreamListener", listed=True),
    _java("input", C, r"""@Input\s*\(["']([^"']+)["']""", "@Input", listed=True),
    _java("subscribe_as_list", C, r"consumer\.subscribe\s*\(\s*Arrays\.asList\s*\((.*?)\)", "consumer.subscribe", listed=True),
    _java("subscribe_list_of", C, r"consumer\.subscribe\s*\(\s*List\.of\s*\((.*?)\)", "consumer.subscribe", listed=True),
    _java("subscribe_set_of", C, r"consumer\.subscribe\s*\(\s*Set\.of\s*\((.*?)\)", "consumer.subscribe", listed=True),
    _java("processor_input", C, r"Processor\.INPUT\b", "Processor.INPUT", topic="input", group=0),
)
GENERIC_PRODUCERS = (
    _generic("record", P, r'new\s+ProducerRecord\s*<[^>]*>\s*\(\s*"([^"]+)"', "ProducerRecord"),
    _generic("any_send", P, r'\.send\s*\(\s*"([^"]+)"', ".send"),
    _generic("template_send", P, r'kafkaTemplate\.send\s*\(\s*"([^"]+)"', "kafkaTemplate.send"),
    _generic("template_send_const", P, r"kafkaTemplate\.send\s*\(\s*([A-Z_]+)\b", "kafkaTemplate.send"),
    _generic("producer_send_const", P, r"producer\.send\s*\(\s*([A-Z_]+)\b", "producer.send"),
    _generic("record_const", P, r"new\s+ProducerRecord\s*<[^>]*>\s*\(\s*([A-Z_]+)\b", "ProducerRecord"),
    _generic("send_to", P, r'@SendTo\s*\(\s*"([^"]+)"\s*\)', "@SendTo"),
    _generic("output", P, r'@Output\s*\(\s*"([^"]+)"\s*\)', "@Output"),
)
GENERIC_CONSUMERS = (
    _generic("subscribe", C, r'\.subscribe\s*\(\s*(?:Arrays\.asList|List\.of)\s*\(\s*"([^"]+)"\s*\)', ".subscribe"),
    _generic("subscribe_const", C, r"\.subscribe\s*\(\s*(?:Arrays\.asList|List\.of)\s*\(\s*([A-Z_]+)\s*\)", ".subscribe"),
    _generic("listener", C, r'@KafkaListener\s*\(\s*topics\s*=\s*"([^"]+)"\s*\)', "@KafkaListener"),
    _generic("listener_const", C, r"@KafkaListener\s*\(\s*topics\s*=\s*([A-Z_]+)\s*\)", "@KafkaListener"),
    _generic(
        "listener_list",
        C,
        r'@KafkaListener\s*\(\s*topics\s*=\s*\{\s*"([^"]+)"(?:\s*,\s*"[^"]+")*\s*\}\s*\)',
        "@KafkaListener",
    ),
    _generic(
        "listener_list_const",
        C,
        r"@KafkaListener\s*\(\s*topics\s*=\s*\{\s*([A-Z_]+)(?:\s*,\s*[A-Z_]+)*\s*\}\s*\)",
        "@KafkaListener",
    ),
    _generic("stream_listener", C, r'@StreamListener\s*\(\s*"([^"]+)"\s*\)', "@StreamListener"),
    _generic("input", C, r'@Input\s*\(\s*"([^"]+)"\s*\)', "@Input"),
)
SPRING_PRODUCERS = (
    _spring("output", P, r"""@Output\s*\(\s*["']([^"']+)["']\)""", "@Output"),
    _spring("send_to", P, r"""@SendTo\s*\(\s*["']([^"']+)["']\)""", "@SendTo"),
    _spring("activator_out", P, r"""@ServiceActivator\s*\(\s*outputChannel\s*=\s*["']([^"']+)["']\)""", "@ServiceActivator"),
    _spring("event_bus", P, r"""eventBus\.publish\s*\(\s*["']([^"']+)["']\)""", "eventBus.publish"),
    _spring("convert_and_send", P, r"""template\.convertAndSend\s*\(\s*["']([^"']+)["']\)""", "template.convertAndSend"),
    _spring("outbound_adapter", P, r"""@OutboundChannelAdapter\s*\(\s*channel\s*=\s*["']([^"']+)["']\)""", "@OutboundChannelAdapter"),
    _spring("supplier_bean", P, r"(?U)Supplier<[^>]+>\s+(\w+)\s*\(\s*\)\s*\{", "Supplier<"),
)
SPRING_CONSUMERS = (
    _spring("stream_listener", C, r"""@StreamListener\s*\(\s*["']([^"']+)["']\)""", "@StreamListener"),
    _spring("input", C, r"""@Input\s*\(\s*["']([^"']+)["']\)""", "@Input"),
    _spring("activator_in", C, r"""@ServiceActivator\s*\(\s*inputChannel\s*=\s*["']([^"']+)["']\)""", "@ServiceActivator"),
    _spring("event_listener", C, r"""@EventListener\s*\(\s*["']([^"']+)["']\)""", "@EventListener"),
    _spring("listener", C, r"""@KafkaListener\s*\(\s*topics\s*=\s*["']([^"']+)["']\)""", "@KafkaListener"),
    _spring("rabbit_listener", C, r"""@RabbitListener\s*\(\s*queues\s*=\s*["']([^"']+)["']\)""", "@RabbitListener"),
    _spring("inbound_adapter", C, r"""@InboundChannelAdapter\s*\(\s*channel\s*=\s*["']([^"']+)["']\)""", "@InboundChannelAdapter"),
    _spring("consumer_bean", C, r"(?U)Consumer<[^>]+>\s+(\w+)\s*\(\s*\)\s*\{", "Consumer<"),
    _spring("function_bean", C, r"(?U)Function<[^>]+>\s+(\w+)\s*\(\s*\)\s*\{", "Function<"),
)
PRODUCERS = JAVA_PRODUCERS + GENERIC_PRODUCERS + SPRING_PRODUCERS
CONSUMERS = JAVA_CONSUMERS + GENERIC_CONSUMERS + SPRING_CONSUMERS
CATALOGUE = PRODUCERS + CONSUMERS

# Constants, configuration keys and declarations.
JAVA_CONSTANT = r"""(?U)private\s+(?:static\s+final\s+)?String\s+(\w+)\s*=\s*["']([^"']+)["']"""
GENERIC_CONSTANT = r'(?:private|public|static)\s+(?:final\s+)?String\s+([A-Z_]+)\s*=\s*"([^"]+)"'
VALUE_FIELD = r'@Value\s*\(\s*"\$\{([^}]+\.topic)\}"\s*\)\s*private\s+String\s+([^;\s]+)'
BINDING_DESTINATION = r"spring\.cloud\.stream\.bindings\.([^.]+)\.destination\s*="
TOPIC_CONFIG = r'@TopicConfig\s*\(\s*name\s*=\s*"([^"]+)"'
VALUE_KEY = r"""@Value\s*\(\s*["']?\$\{([^}]+)\}["']?\)"""
CONST_SEND = r"(?U)(?:producer|template)\.(?:send|publish)\s*\(\s*(\w+)"
CONST_SUBSCRIBE = r"consumer\.subscribe\s*\(([^)]*)"
CONTEXT_CHARS = 200
PRODUCER_WORDS = ("producer", "send", "publish", "@sendto")

# Framework markers.
SPRING_IGNORE = ("@SpringBootTest", "@TestConfiguration", "@MockBean", "@TestComponent")
SPRING_APPLICATION = "@SpringBootApplication"
REST_MARKERS = ("@RestController", "@Controller")
REST_MAPPING = r"""@(Request|Get|Post|Put|Delete|Patch)Mapping\s*\(\s*["']([^"']+)["']\)"""
STREAM_BINDING = r"spring\.cloud\.stream\.bindings\.([^.]+)\.(?:destination|topic)\s*=\s*([^\s]+)"
SERVICE_URL = r"(?U)([\w-]+)\.url\s*=\s*([^\s]+)"
INJECTIONS = (
    (r"(?U)@Autowired\s+(?:private\s+)?(\w+)\s+\w+", "@Autowired"),
    (r"""@Qualifier\s*\(\s*["']([^"']+)["']\)""", "@Qualifier"),
    (r"""@DependsOn\s*\(\s*["']([^"']+)["']\)""", "@DependsOn"),
)
SPRING_CONFIGS = ("application.properties", "application.yml", "application.yaml")
YAML_CONFIGS = ("application.yml", "application.yaml")
#: last keys of the settings that a needle asks for, where they are nested
NESTED_KEYS = {"spring.cloud.stream.bindings.": ("destination", "topic"), ".url": ("url",)}

# File selection.
SOURCE_SUFFIXES = (
    ".java", ".kt", ".scala", ".py", ".js", ".ts", ".go", ".cs",
    ".xml", ".yaml", ".yml", ".properties", ".gradle", ".sbt",
)
SKIPPED_DIRS = (
    "node_modules", "_sokrates", "target", "build", "dist",
    "venv", "__pycache__", ".git", ".idea", ".vscode",
)
TEST_DIRS = ("test", "tests", "src/test", "src/tests")

# Build files by language, in order of preference.
BUILD_FILES = (
    ("java", "pom.xml"),
    ("java", "build.gradle"),
    ("java", "build.gradle.kts"),
    ("javascript", "package.json"),
    ("python", "pyproject.toml"),
    ("python", "setup.py"),
    ("python", "requirements.txt"),
    ("csharp", ".csproj"),
)
LANGUAGE_SUFFIXES = {
    "java": (".java",),
    "python": (".py",),
    "javascript": (".js", ".ts"),
    "csharp": (".cs",),
}
DEPENDENCY_WORDS = ("service", "client", "api")
REQUIREMENT = r"(?mU)^\s*([\w-]+(?:-client|-service|-api))\s*(?:[>=<~]|$)"

# Schema references.
REGISTRY_CALL = r"""schemaRegistry\.(?:get|register)Schema\(["']([^"']+)["']\)"""
REGISTRY_URL = r"https?://[^/]+/subjects/[^/]+/versions/\d+"
REGISTRY_BASE = "http://localhost:8081"
REGISTRY_SUFFIXES = (".java", ".kt", ".scala", ".py", ".js", ".ts")
JVM_SUFFIXES = (".java", ".kt", ".scala")
SIMPLE_JAVA_TYPES = ("int", "long", "float", "double", "boolean", "String")
