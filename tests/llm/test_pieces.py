import hashlib
import random

import numpy as np
import pytest
from topicloom.llm import pieces


@pytest.fixture(scope="module")
def tool():
    return pieces.codec(pieces.default_model())


ODD = [
    None, "", " ", "   ", "\n", "a", "  two  blanks ", "\ttab\r\n", "▁", "a▁b", "<s>", "<0x0A>", "\x00", "☃ é ß 中文字",
    "x" * 5000, "=" * 999 + " " * 999, "中" * 300, "ab" * 70 + "\n" + "☃" * 70, "\U0001f600" * 70, "  \n  \n",
]


def test_like_the_library(tool):
    r = random.Random(5)
    known = list(tool.id)
    texts = [t or "" for t in ODD]
    for _ in range(3000):
        texts.append("".join(
            r.choice(known).replace("▁", " ") if r.random() < 0.7 else r.choice("a\n ☃\té\".=▁")
            for _ in range(r.randrange(1, 14))
        ))
    offsets, ids = tool.encode_batch(texts)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == tool.processor.encode(texts)


def test_pairs_match_their_definition(tool):
    r = random.Random(6)
    some = sorted(tool.split)
    for _ in range(3000):
        a, b = r.choice(some), r.choice(some)
        if pieces.BLANK in tool.piece[b] or not tool.piece[a].startswith(pieces.BLANK):
            continue
        want = tool.processor.encode((tool.piece[a] + tool.piece[b]).replace(pieces.BLANK, " ")[1:])
        assert tool.compatible(a, b) == (want == [a, b])


def test_small_memory_gives_the_same(tool, monkeypatch):
    texts = [f"word{i} other{i * 7 % 13}  end\n" * (i % 5) for i in range(200)]
    want = [x.tolist() for x in tool.encode_batch(texts)]
    monkeypatch.setattr(pieces, "MOST_UNITS", 3)
    small = pieces.Codec(pieces.default_model())
    small.known = pieces.Table(40)
    got = []
    for t in texts:
        got += small.encode_batch([t])[1].tolist()
    assert got == want[1]


def test_documents(spark, tool):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = pieces.with_digests(pieces.encode_documents(docs)).collect()
    assert len(out) == len(rows)
    text = dict((i, t or "") for i, t, _ in rows)
    for r in out:
        ids = tool.processor.encode(text[r.doc_id])
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), tool.processor.decode(ids) if ids else "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    empty = spark.createDataFrame([], docs.schema)
    assert pieces.encode_documents(empty).count() == 0


def test_ids_of_units_come_as_arrays_not_as_an_object_a_piece(tool):
    text = "the é中☃ two words\n" + "ab" * 40 + "  x " + "☃" * 70 + "中" * 64
    for part in (text, "the", "\n", "☃"):
        units = pieces.UNITS.findall(pieces.BLANK + part.replace(" ", pieces.BLANK))
        sizes, ids = tool.encode_units(units)
        assert isinstance(sizes, np.ndarray) and isinstance(ids, np.ndarray)
        assert len(sizes) == len(units) and ids.tolist() == tool.processor.encode(part)
        ends = np.cumsum(sizes).tolist()
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [tool.encode_units([u])[1].tolist() for u in units]
