import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import chat


def turns(n=120, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    rows = []
    for c in range(n):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * r.randrange(1, 5)
        for t, role in enumerate(roles):
            lines = [" ".join(word() for _ in range(r.randrange(2, 9 if role == "user" else 40))) + ("?" if role == "user" else ".") for _ in range(r.randrange(1, 4))]
            rows.append((c, t, role, "\n".join(lines)))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    frame = spark.createDataFrame(turns(), "conv_id bigint, turn bigint, role string, text string")
    rows = chat.turn_transcripts(frame).cache()
    return rows, chat.fit(rows.where(~chat.held_out(F.col("id"))))


def brute_path(model, symbols):
    """Viterbi over the whole, the plain way."""
    score, back = model.start + model.emit[:, symbols[0]], []
    for s in symbols[1:]:
        options = score[:, None] + model.move
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + model.emit[:, s]
    return score.max()


def score_of(model, symbols, states):
    total = model.start[states[0]] + model.emit[states[0], symbols[0]]
    for a, b, s in zip(states, states[1:], symbols[1:]):
        total += model.move[a, b] + model.emit[b, s]
    return total


def test_roles_of_held_out_transcripts(spark, made):
    rows, model = made
    parsed = {r.id: r for r in chat.parse_transcripts(rows.select("id", "part", "text"), model).collect()}
    truth = {}
    for c, _, role, text in turns():
        truth.setdefault(c, []).append((role, text))
    held = {r.id for r in rows.where(chat.held_out(F.col("id"))).collect()}
    right = total = whole = 0
    for c in held:
        want = "".join(f"<|im_start|>{role}\n{text}\n<|im_end|>\n" for role, text in truth[c])
        whole += parsed[c].rendered == want
        total += len(truth[c])
        right += sum(a == b for a, (b, _) in zip(parsed[c].roles, truth[c])) if len(parsed[c].roles) == len(truth[c]) else 0
    assert len(held) > 15 and right / total > 0.9 and whole / len(held) > 0.85


def test_parts_give_the_path_of_the_whole(spark, made, monkeypatch):
    monkeypatch.setattr(chat, "FAN_BITS", 1)
    _, model = made
    texts = [t for *_, t in sorted(turns(12, 5))]
    lines = [x for k, t in enumerate(texts) for x in ([["User: ", "", "A: "][k % 3] + t, ""][: 1 + k % 2])]
    whole = "\n".join(lines)
    rows = [("w", 0, whole), (None, 0, None), ("e", 3, "")]
    rows += [("p", k, x) for k, x in enumerate(lines)]
    got = chat.parse_transcripts(spark.createDataFrame(rows, "id string, part bigint, text string"), model).collect()
    by = {i: "".join(r.rendered for r in sorted((r for r in got if r.id == i), key=lambda r: r.part)) for i in ("w", "p", "e", None)}
    assert len(got) == len(rows) and by[None] == by["e"] == ""
    # a blank line at the end of a part is not seen by the next: compare without them
    symbols, cuts, opening = [], [], True
    for x in lines:
        s = chat.read_lines(x, opening)[1]
        opening = opening and not s
        symbols += s
        cuts.append(len(symbols))
    matrices = np.array([model.part_matrix(symbols[a:b], a == 0) for a, b in zip([0, *cuts], cuts)])
    best = brute_path(model, symbols)
    assert np.isclose(chat.product(matrices)[0].max(), best)
    ends, states, before = chat.chain(matrices, 0, None), [], 0
    for a, b, end in zip([0, *cuts], cuts, ends):
        states += model.path(symbols[a:b], a == 0, before, end)
        before = end
    assert np.isclose(score_of(model, symbols, states), best)
    assert by["p"].count("<|im_start|>") == sum(s % 2 == 0 for s in states)


def test_long_conversation_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_ROWS", 8)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"say {t}") for t in range(300)]
    rows += [(2, 5, "user", f"same number {k}") for k in range(40)] + [(3, None, "tool", "x"), (3, 0, None, None), (None, 0, "user", "<|im_end|>"), (None, 0, "user", "<|im_end|>")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, id string")
    made = chat.turn_transcripts(frame).cache()
    assert made.groupBy("id").count().where("id = 1").first()["count"] >= 5
    model = chat.fit(made)
    got = chat.parse_transcripts(made.select("id", "part", "text"), model).collect()
    one = "".join(r.rendered for r in sorted((r for r in got if r.id == 1), key=lambda r: r.part))
    assert one == "".join(f"<|im_start|>{role}\n{text}\n<|im_end|>\n" for _, _, role, text in rows[:300])
    assert sum(r.n_lines for r in got if r.id == 2) == 40
    assert "< |im_end" in next(r.rendered for r in got if r.id is None)
    empty = chat.turn_transcripts(frame.limit(0))
    assert chat.parse_transcripts(empty.select("id", "part", "text"), chat.fit(empty)).count() == 0


def test_every_cut_gives_the_whole(spark):
    """Transcripts cut at every line, at random and with empty parts, against the same in one part."""
    rng = random.Random(4)
    starts = ["User: ", "Assistant: ", "", "", "### Response:", "Q: "]
    rows, whole = [], {}
    for i in range(40):
        lines = [rng.choice(["", "", " "]) if rng.random() < 0.3 else rng.choice(starts) + rng.choice(["hi", "fine, you?", "ok " * 40]) for _ in range(rng.randint(1, 9))]
        if i == 0:
            lines = ["", "hello there", "second line"]
        if i == 1:
            lines = ["User: hi", "", "fine, you?"]
        whole[i] = "\n".join(lines)
        rows.append((i * 1000, 0, whole[i]))
        cuts = [{k} for k in range(1, len(lines))] + [set(rng.sample(range(1, len(lines)), rng.randint(0, len(lines) - 1))) for _ in range(3)]
        for c, cut in enumerate(cuts, 1):
            at = [0, *sorted(cut), len(lines)]
            rows += [(i * 1000 + c, p, "\n".join(lines[a:b])) for p, (a, b) in enumerate(zip(at, at[1:]))]
    parts = spark.createDataFrame(rows, "id bigint, part bigint, text string")
    flat = np.random.default_rng(1).random(chat.STATES * (chat.STATES + 1 + chat.SYMBOLS)) * 5
    a, b = chat.STATES, chat.STATES * (chat.STATES + 1)
    model = chat.Model(flat[:a], flat[a:b].reshape(chat.STATES, -1), flat[b:].reshape(chat.STATES, -1))
    out: dict[int, list] = {}
    for r in chat.parse_transcripts(parts, model).collect():
        out.setdefault(r["id"], []).append((r["part"], r["rendered"], list(r["roles"])))
    text = {i: "".join(x[1] for x in sorted(held)) for i, held in out.items()}
    roles = {i: [y for x in sorted(held) for y in x[2]] for i, held in out.items()}
    assert len(out) == len({r[0] for r in rows})
    for i in out:
        assert text[i] == text[i // 1000 * 1000] and roles[i] == roles[i // 1000 * 1000], (i, whole[i // 1000])
