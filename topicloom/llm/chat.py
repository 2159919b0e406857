"""Chat formatting: a hidden Markov model recovers the turns of transcripts, exactly and in parts.

States are role times (first line of a turn, later line). A line is seen as a symbol of its
speaker marker, if any, a blank line before it, being the first of all, its length and a
question mark at its end. The model is counted from transcripts whose turns are known;
Viterbi finds the most likely states; turns are rendered in one canonical form:
``<|im_start|>role``, the text, ``<|im_end|>``.

A transcript may come in ordered parts. A part alone gives the best score between every
pair of states at its ends, a small matrix; matrices of up to 256 parts make one of the next
level, up to the whole transcript. From the top the states at the cuts are settled level
by level, then each part finds its own lines: the same path as of one pass over the whole,
without any task that holds a long transcript. The whole are the parts joined by line feeds; a part
is told whether a line came before it, and whether the last one before it was blank.

Defined results: null and empty texts have no lines, no turns and render to nothing;
rows without an id are a transcript like others; parts that repeat a number are taken in
hash order of their text; lines before any marker belong to whom the model finds likelier; ``<|`` in a
text is written ``< |``; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.operators.views import dense_index
from topicloom.session import materialize

ROLES = ("user", "assistant", "system")
NAMES = {
    "user": ("user", "human", "customer", "q", "question", "prompt", "instruction", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "response", "agent", "model"),
    "system": ("system", "sys", "context"),
}
ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(
    r"\s*(?:(?:#{2,4}|>{1,2})\s*(" + "|".join(ROLE_OF) + r")\s*:?\s*(?:$|(?<=:))|(?:\*\*|\[|<)?(" + "|".join(ROLE_OF) + r")(?:\*\*|\]|>)?\s*:(?:\*\*)?)\s*",
    re.IGNORECASE,
)
STATES = 2 * len(ROLES)  # role * 2 + (0: first line of a turn, 1: later line)
SYMBOLS = (len(ROLES) + 1) * 16
FAN_BITS = 8  # 256 parts make one of the next level


def read_lines(text: str | None, opening: bool, blank: bool = False) -> tuple[list[str], list[int]]:
    """(lines that are not blank, their symbols); ``opening``: the first line begins the transcript;
    ``blank``: a blank line came just before the text."""
    lines, symbols, first = [], [], opening
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        m = MARKER.match(line)
        who = ROLE_OF[(m[1] or m[2]).lower()] + 1 if m else 0
        rest = line[m.end() :] if m else line
        symbols.append((((who * 2 + blank) * 2 + first) * 2 + (len(rest) > 80)) * 2 + rest.rstrip().endswith("?"))
        lines.append(line)
        blank = first = False
    return lines, symbols


class Model:
    """Log chances, from counts and what is expected without any."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, seen: np.ndarray):
        # a later line follows a line of its own role; this holds without counting
        possible = np.ones((STATES, STATES), bool)
        for i in range(STATES):
            for j in range(1, STATES, 2):
                possible[i, j] = i // 2 == j // 2
        starts = starts + np.tile([1.0, 1e-3], len(ROLES))
        self.start = np.log(starts / starts.sum())
        moves = np.where(possible, moves + 0.5, 0)
        with np.errstate(divide="ignore"):
            self.move = np.log(moves / moves.sum(axis=1, keepdims=True))
        # a marker and what else a line shows, each by itself; a role's first line is
        # expected to carry its marker or none, a later line none, until counts say more
        expected = np.full((STATES, len(ROLES) + 1), 0.02)
        expected[:, 0] = np.tile([0.5, 2.0], len(ROLES))
        expected[np.arange(0, STATES, 2), np.arange(len(ROLES)) + 1] = 2.0
        seen = seen.reshape(STATES, len(ROLES) + 1, 16)
        marker, rest = seen.sum(axis=2) + expected, seen.sum(axis=1) + 0.5
        marker, rest = (x / x.sum(axis=1, keepdims=True) for x in (marker, rest))
        self.emit = np.log(marker[:, :, None] * rest[:, None, :]).reshape(STATES, SYMBOLS)

    def part_matrix(self, symbols: list[int], opening: bool) -> np.ndarray:
        """Best score from each state before the part (any, if it opens) to each at its end."""
        best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for k, s in enumerate(symbols):
            if k == 0 and opening:
                best = np.tile(self.start + self.emit[:, s], (STATES, 1))
            else:
                best = (best[:, :, None] + self.move[None]).max(axis=1) + self.emit[:, s]
        return best

    def path(self, symbols: list[int], opening: bool, before: int, last: int) -> list[int]:
        """The best states of a part between the state before it and its last state."""
        if not symbols:
            return []
        score = (self.start if opening else self.move[before]) + self.emit[:, symbols[0]]
        back = []
        for s in symbols[1:]:
            options = score[:, None] + self.move
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + self.emit[:, s]
        states = [last]
        for pointers in reversed(back):
            states.append(int(pointers[states[-1]]))
        return states[::-1]


def chain(matrices: np.ndarray, before: int, last: int | None) -> list[int]:
    """States at the end of each of some consecutive parts, the first entered from ``before``."""
    score, back = matrices[0][before], []
    for m in matrices[1:]:
        options = score[:, None] + m
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    states = [int(score.argmax()) if last is None else last]
    for pointers in reversed(back):
        states.append(int(pointers[states[-1]]))
    return states[::-1]


def product(matrices: np.ndarray) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def _ordered(parts: DataFrame) -> DataFrame:
    """(id, part, text, key): ``key`` names the id (null too), ``part`` is unique in it and in order."""
    rows = parts.select("id", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), "text").withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null")))
    return rows


def fit(known: DataFrame) -> Model:
    """A model from all of (text, opening, truth), ``truth`` the state of every line that is not blank."""

    def run(batches):
        starts, moves, seen = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        for batch in batches:
            for row in batch.to_pylist():
                _, symbols = read_lines(row["text"], row["opening"])
                truth = row["truth"] or []
                if len(truth) != len(symbols):
                    continue
                for k, (s, state) in enumerate(zip(symbols, truth)):
                    if state < 0:
                        continue
                    seen[state, s] += 1
                    if k == 0 and row["opening"]:
                        starts[state] += 1
                    elif k and truth[k - 1] >= 0:
                        moves[truth[k - 1], state] += 1
        flat = np.concatenate([starts, moves.ravel(), seen.ravel()])
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(flat)), pa.int32()), "n": pa.array(flat)})

    counted = known.select("text", "opening", "truth").mapInArrow(run, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS)
    for r in counted:  # as many rows as the model has numbers
        flat[r["k"]] = r["n"]
    a, b = STATES, STATES + STATES * STATES
    return Model(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, SYMBOLS))


def _matrices(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, STATES, STATES)


def _placed(rows: DataFrame) -> DataFrame:
    """(key, n, opening, closing, blank) of numbered parts: whether no line came before, whether no part
    comes behind, whether the part before ends in a blank line."""

    def look(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                lines = [[bool(x.strip()) for x in (t or "").split("\n")] for t in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(map(any, lines), pa.bool_()), pa.array([not x[-1] for x in lines], pa.bool_())],
                    names=["key", "n", "spoken", "ends_blank"],
                )

    seen = materialize(rows.select("key", "n", "text").mapInArrow(look, "key string, n bigint, spoken boolean, ends_blank boolean"), "seen")
    edges = seen.groupBy("key").agg(F.max("n").alias("final"), F.min(F.when(F.col("spoken"), F.col("n"))).alias("line"))
    before = seen.select("key", (F.col("n") + 1).alias("n"), F.col("ends_blank").alias("blank"))
    return seen.join(edges, "key").join(before, ["key", "n"], "left").select(
        "key", "n", (F.col("line").isNull() | (F.col("n") <= F.col("line"))).alias("opening"), (F.col("n") == F.col("final")).alias("closing"),
        F.coalesce("blank", F.lit(False)).alias("blank"),
    )


def parse_transcripts(parts: DataFrame, model: Model) -> DataFrame:
    """(id, part, n_lines, n_turns, roles, rendered) of ``parts`` (id, part, text).

    n_turns and roles are of the turns that begin in the part; ``rendered`` of the parts of
    a transcript, one after another, is the whole in canonical form.
    """
    kind = parts.schema["id"].dataType.simpleString()
    # numbers in the order of the parts, without gathering a transcript anywhere
    rows = dense_index(_ordered(parts), ["key", "part", "h"], "n")
    rows = rows.join(_placed(rows), ["key", "n"]).select("id", "key", "part", "n", "text", "opening", "closing", "blank")
    rows = materialize(rows, "numbered")

    def score(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                asked = zip(*(piece.column(i).to_pylist() for i in (2, 3, 4)))
                found = [model.part_matrix(read_lines(t, o, b)[1], o).ravel() for t, o, b in asked]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))], names=["key", "node", "m"]
                )

    def join(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("node").to_numpy())
        m = product(_matrices(rows.column("m"))[order])
        return pa.table({"key": rows.column("key")[:1], "node": pa.array([rows.column("up")[0].as_py()], pa.int64()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    def settle(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        order = np.argsort(node)
        before, last = rows.column("before")[0].as_py(), rows.column("last")[0].as_py()
        ends = chain(_matrices(rows.column("m"))[order], before, None if last < 0 else last)
        return pa.table({"key": rows.column("key"), "node": node[order], "before": np.array([before, *ends[:-1]], np.int32), "last": np.array(ends, np.int32)})

    matrix = "key string, node bigint, m array<double>"
    levels = [materialize(rows.select("key", "n", "text", "opening", "blank").mapInArrow(score, matrix), "matrices")]
    while True:
        many = levels[-1].groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
        if many.isEmpty():
            break
        up = levels[-1].join(many, "key", "left_semi").withColumn("up", F.shiftright("node", FAN_BITS))
        levels.append(materialize(up.groupBy("key", "up").applyInArrow(join, matrix), "matrices"))
    ends = None
    for level in reversed(levels):
        up = level.withColumn("up", F.shiftright("node", FAN_BITS))
        if ends is None:
            given = up.withColumn("before", F.lit(0)).withColumn("last", F.lit(-1))
        else:
            above = ends.select("key", F.col("node").alias("up"), "before", "last")
            given = up.join(above, ["key", "up"], "left").fillna({"before": 0, "last": -1})
        ends = materialize(given.groupBy("key", "up").applyInArrow(settle, "key string, node bigint, before int, last int"), "ends")

    def render(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                out = [render_part(model, r) for r in piece.select(["text", "opening", "closing", "blank", "before", "last"]).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([x[0] for x in out], pa.int32()), pa.array([len(x[1]) for x in out], pa.int32()),
                     pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.string())],
                    names=["id", "part", "n_lines", "n_turns", "roles", "rendered"],
                )

    placed = rows.join(ends.withColumnRenamed("node", "n"), ["key", "n"]).select("id", "part", "text", "opening", "closing", "blank", "before", "last")
    return placed.mapInArrow(render, f"id {kind}, part bigint, n_lines int, n_turns int, roles array<string>, rendered string")


def render_part(model: Model, row: dict) -> tuple[int, list[str], str]:
    lines, symbols = read_lines(row["text"], row["opening"], row["blank"])
    states = model.path(symbols, row["opening"], row["before"], row["last"])
    roles, out = [], []
    for k, (line, state) in enumerate(zip(lines, states)):
        opens = state % 2 == 0 or (k == 0 and row["opening"])
        if opens:
            role = ROLES[state // 2]
            if not (k == 0 and row["opening"]):
                out.append("<|im_end|>\n")
            out.append(f"<|im_start|>{role}\n")
            roles.append(role)
            m = MARKER.match(line)
            line = line[m.end() :] if m else line
            if m and not line.strip():
                continue
        out.append(line.replace("<|", "< |") + "\n")
    if row["closing"] and (lines or not row["opening"]):
        out.append("<|im_end|>\n")
    return len(lines), roles, "".join(out)


# --- transcripts of a table of turns ----------------------------------------------

STYLES = (
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "System: "},
    {"user": "### Instruction:\n", "assistant": "### Response:\n", "system": "### System:\n"},
    {"user": "Q: ", "assistant": "A: ", "system": "Context: "},
    {"user": "**User:** ", "assistant": "**Assistant:** ", "system": "**System:** "},
    {"user": "[USER]: ", "assistant": "[BOT]: ", "system": "[SYSTEM]: "},
)
PART_TURNS = 64
PART_ROWS = 256
NO_TURN = 1 << 36  # where rows without a number come


def turn_transcripts(turns: DataFrame) -> DataFrame:
    """(id, part, text, opening, truth) of ``conversations``-like rows: raw transcripts as people paste
    them, each in some style of markers, one marker in eight missing with a blank line instead.

    A conversation of any length is cut every ``PART_TURNS`` turn numbers, and numbers that
    hold over ``PART_ROWS`` rows by the hash of the row, which also orders turns of one number.
    """
    number = F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN))
    rows = turns.select(
        F.col("conv_id").alias("id"), number.alias("turn"), F.xxhash64("role", "text").alias("h"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    cut = F.floor(F.greatest(F.lit(-NO_TURN), F.least(F.lit(NO_TURN), "turn")) / PART_TURNS).cast("bigint")
    rows = rows.withColumn("slot", cut)
    crowd = rows.groupBy("id", "slot", "turn").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("bigint").alias("cuts")).where("cuts > 1")
    crowd = materialize(crowd.select(F.col("id").alias("cid"), F.col("slot").alias("cslot"), F.col("turn").alias("cturn"), "cuts"), "crowds")
    slots = crowd.select("cid", "cslot").distinct()
    in_slot = F.col("id").eqNullSafe(F.col("cid")) & (F.col("slot") == F.col("cslot"))
    rows = rows.join(slots, in_slot, "left").withColumn("crowded", F.col("cslot").isNotNull()).drop("cid", "cslot")
    rows = rows.join(crowd.drop("cslot"), F.col("id").eqNullSafe(F.col("cid")) & (F.col("turn") == F.col("cturn")), "left")
    share = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 1).cast("double") / float(1 << 63)
    cuts = F.coalesce("cuts", F.lit(1))
    at = F.pmod("turn", F.lit(PART_TURNS)) * (1 << 20) + F.least(F.floor(share * cuts), cuts - 1)
    sub = F.when(F.col("crowded"), at).otherwise(F.lit(0))
    grouped = rows.withColumn("part", F.col("slot") * (1 << 30) + sub.cast("bigint")).groupBy("id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "h", "role", "text"))).alias("turns")
    )
    first = grouped.groupBy("id").agg(F.min("part").alias("least")).withColumnRenamed("id", "fid")
    grouped = grouped.join(first, F.col("id").eqNullSafe(F.col("fid"))).select(
        "id", "part", "turns", (F.col("part") == F.col("least")).alias("opening"), F.pmod(F.xxhash64("id"), F.lit(len(STYLES))).cast("int").alias("style")
    )
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                piece = batch.slice(start, 128)
                made = [_write(r["turns"], r["opening"], r["style"]) for r in piece.select(["turns", "opening", "style"]).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([m[0] for m in made], pa.string()), piece.column(3), pa.array([m[1] for m in made], pa.list_(pa.int32()))],
                    names=["id", "part", "text", "opening", "truth"],
                )

    return grouped.mapInArrow(run, f"id {kind}, part bigint, text string, opening boolean, truth array<int>")


def _write(turns: list[dict], opening: bool, style: int) -> tuple[str, list[int]]:
    text, truth = [], []
    for k, t in enumerate(turns):
        role = (t["role"] or "").lower()
        known = role in ROLES
        marked = known and ((opening and k == 0) or t["h"] % 8 != 0)
        if not marked and (k or not opening):
            text.append("")
        said = (STYLES[style][role] if marked else "") + t["text"]
        text.append(said)
        held = sum(1 for line in said.split("\n") if line.strip())
        state = 2 * ROLES.index(role) if known else -1
        truth += [state if known else -1] * min(held, 1) + [state + 1 if known else -1] * (held - 1)
    return "\n".join(text), truth


def held_out(column):
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


@query("op7_chat_formatting")
def chat_formatting(spark, sf):
    """Transcripts of all conversations, parsed by a model counted on three quarters of them."""
    made = materialize(turn_transcripts(table(spark, sf, "conversations")), "transcripts")
    model = fit(made.where(~held_out(F.col("id"))))
    return parse_transcripts(made.select("id", "part", "text"), model).withColumnRenamed("id", "conv_id")
