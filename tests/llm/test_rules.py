import re

from topicloom.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(marked),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h",
    "x " * 30, "é\xa0ß word next " * 9 + "end", "l1\nl1\n\n l1\nl2\nl1",
    "# a ** b | c <d> " * 6, " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i % 13}" for i in range(500)), " ".join(f"word{i}" for i in range(40_000)),
]


def test_measures_match_brute_force():
    for text in TEXTS[:-1]:
        got = rules.Text(text)
        assert tuple(got[m] for m in rules.DIGEST) == brute(text), text
    assert rules.Text(TEXTS[-1])["n_repeat_words"] == 0


def test_verdicts_and_clashing_columns(spark):
    rows = [(i, t, i % 2) for i, t in enumerate(TEXTS)] + [(10, TEXTS[10], 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    judged = rules.judge_documents(docs).collect()
    assert len(judged) == len(rows)
    assert {r.doc_id for r in judged if r.kept} == {10, 12}
    by = {r.doc_id: r.rejected_by for r in judged}
    assert by[0] == "few_words" and by[10] is None
    assert {r.doc_id for r in judged if r.base_failed} >= {0, 1, 2, 3, 4, 5, 6}
    kept = rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 10, 12]


def test_order_follows_rejection_per_cost_and_not_the_verdict(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = rules.plan_cascade(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules.RULES)
    given = rules.judge_documents(docs, rules.RULES).select("doc_id", "kept").collect()
    turned = rules.judge_documents(docs, rules.RULES[::-1]).select("doc_id", "kept").collect()
    assert sorted(given) == sorted(turned)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert rules.judge_documents(docs).count() == 0
    assert rules.keep_documents(docs).count() == 0
