"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is a sequence of lines. The states are each role's first line of
a turn and its further lines. A line's features are what stands before its
text (a known speaker name, an unknown marker, or nothing), the bracket style of
that marker, whether the line before was blank, whether it ends in a question
mark, and its length class. Transition and emission tables are counted from
labelled lines (every one of them; the tables have a fixed size) and smoothed
by one. Viterbi recovers the roles; canonical turns are rendered from them.

A transcript may be of any length: rows are numbered once, in the order of the
turn and then of the table, and cut into chunks of ``CHUNK_TURNS`` turns. Where a chunk
has over ``CHUNK_ROWS`` rows (a turn number that repeats, rows without one) it is
cut further, by turn and by the rows' numbers. Pass one reduces each chunk to a matrix of best scores from each entry
to each exit state, for either kind of line before it; pass two runs Viterbi over a transcript's matrices, one small row for a
chunk; pass three decodes every chunk between its now known end states. The
result is that of one Viterbi over the whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed

ROLES = ("system", "user", "assistant")
STATES = tuple((r, first) for r in ROLES for first in (True, False))
CHUNK_TURNS = 64
CHUNK_ROWS = 1024
_NO_TURN = -(1 << 60)
#: the part of ``cut`` that a row number takes
_ROW_BITS = 50

# fixed values: names by which transcripts mark their speakers
SPEAKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "gpt", "model"),
}
_NAMES = {n: i + 1 for i, r in enumerate(ROLES) for n in SPEAKERS[r]}
_MARKER = re.compile(r"^\s*(?:(#{1,4}\s*)|(\[)|(<\|?(?:im_start\|>)?)|(\*\*)|(>+\s?))?([A-Za-z][A-Za-z_ ]{0,15}?)(?:(?(1)\s*:?\s*$|(?!))|(?(2)\]\s*:?|(?!))|(?(3)\|?>?\s*:?|(?!))|(?(4):?\*\*\s*:?|(?!))|\s*[:>]\s)")
#: values of each feature
SIZES = (5, 7, 2, 2, 4)


def features(line: str, after_blank: bool) -> tuple[tuple[int, ...], int]:
    """The line's feature values, and where its text starts behind a known marker."""
    m = _MARKER.match(line + " ")
    name = _NAMES.get(m[6].strip().lower(), 0) if m else 0
    marker = name or (4 if m else 0)
    style = 0 if not m else next((i for i in range(1, 6) if m[i]), 6)
    start = min(m.end(), len(line)) if name else 0
    n = len(line) - start
    size = 0 if n < 3 else 1 if n < 40 else 2 if n < 200 else 3
    return (marker, style if name else 0, int(after_blank), int(line.rstrip().endswith("?")), size), start


class Model:
    """Log probabilities; ``emit[state, feature, value]``."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    def scores(self, lines: list[str], after_blank: bool = True) -> np.ndarray:
        out = np.empty((len(lines), len(STATES)))
        for i, x in enumerate(lines):
            f, _ = features(x, after_blank)
            out[i] = sum(self.emit[:, j, v] for j, v in enumerate(f))
            after_blank = not x.strip()
        return out


def _viterbi(scores: np.ndarray, move: np.ndarray, entry: np.ndarray, last: int | None = None) -> tuple[float, list[int]]:
    """Best path; ``entry`` holds the log score of each state before the first line's own score."""
    back = np.zeros(scores.shape, np.int8)
    now = entry + scores[0]
    for i in range(1, len(scores)):
        step = now[:, None] + move
        back[i] = step.argmax(axis=0)
        now = step.max(axis=0) + scores[i]
    state = int(now.argmax()) if last is None else last
    best, path = float(now[state]), [state]
    for i in range(len(scores) - 1, 0, -1):
        state = int(back[i, state])
        path.append(state)
    return best, path[::-1]


def _through(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """``[first state, last state]`` -> best score of the chunk."""
    now = np.full((len(STATES), len(STATES)), -np.inf)
    np.fill_diagonal(now, scores[0])
    for i in range(1, len(scores)):
        now = (now[:, :, None] + move[None, :, :]).max(axis=1) + scores[i][None, :]
    return now


def labelled_lines(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, lines, after_blank)`` -> counted observations of the model's tables."""

    def run(batches):
        for b in batches:
            kinds, rows, cols, values = [], [], [], []

            def seen(kind, row, col, value):
                kinds.append(kind)
                rows.append(row)
                cols.append(col)
                values.append(value)

            for role, before, text, blank in zip(*(b.column(i).to_pylist() for i in range(4))):
                if role not in ROLES:
                    continue
                prev = None if before not in ROLES else ROLES.index(before)
                state = 2 * ROLES.index(role)
                for i, line in enumerate((text or "").split("\n")):
                    s = state + (i > 0)
                    if i == 0:
                        # of the turn before only the role is known here: both of its states may be the last
                        for p in (None,) if prev is None else (2 * prev, 2 * prev + 1):
                            seen(0 if p is None else 1, -1 if p is None else p, s, 0)
                    else:
                        seen(1, s if i > 1 else state, s, 0)
                    for j, v in enumerate(features(line, blank)[0]):
                        seen(2, s, j, v)
                    blank = not line.strip()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (kinds, rows, cols, values)], ["kind", "row", "col", "value"])

    return turns.mapInArrow(trimmed(run), "kind int, row int, col int, value int").groupBy("kind", "row", "col", "value").count()


def fit(turns: DataFrame) -> Model:
    """Count the tables over ``turns(role, before, text, after_blank)``, ``before`` the role of the turn before or null.

    Rows of a null or other role are left out; a null text is an empty line, a
    null ``after_blank`` false. Repeated rows count each. No row leaves the
    tables as the smoothing has them.
    """
    n = len(STATES)
    start, move, emit = np.ones(n), np.ones((n, n)), np.zeros((n, len(SIZES), max(SIZES)))
    for j, size in enumerate(SIZES):
        emit[:, j, :size] = 1
    for kind, row, col, value, count in labelled_lines(turns.select("role", "before", "text", "after_blank")).collect():  # at most 6 + 36 + 120 rows
        if kind == 0:
            start[col] += count
        elif kind == 1:
            move[row, col] += count
        else:
            emit[row, col, value] += count
    # a role goes on only from its own lines
    for s in range(n):
        for t in range(1, n, 2):
            if t // 2 != s // 2:
                move[s, t] = 1e-6
    start[1::2] = 1e-6
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=2, keepdims=True)))


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows with their chunk, sorted, each chunk within one partition."""
    return rows.repartition("conv_id", "chunk", "cut").sortWithinPartitions("conv_id", "chunk", "cut", "turn", "rid")


def _groups(batches, keys: int):
    """Rows of a sorted stream, a list for each run of equal keys."""
    held, key = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                held, key = [], row[:keys]
            held.append(row)
    if held:
        yield key, held


def parse(transcripts: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``(conv_id, chunk, cut, line, role, starts_turn, text)`` for each line of the transcripts.

    ``transcripts`` holds pieces of raw transcript text in the order of
    ``turn_col``, those of one turn in the order of the table; how they are cut
    into rows has no influence on roles beyond the line breaks between rows.
    ``line`` numbers lines within a chunk; lines are ordered by ``(chunk, cut,
    line)``. Null texts are empty lines; pieces without a conversation or turn
    keep their rows, nulls being one conversation, or turn, of their own that
    comes first. Repeated rows are lines like any other. Extra columns are
    pruned; an empty table gives an empty table.
    """
    spark = transcripts.sparkSession
    turn = F.col(turn_col).cast("long")
    rows = materialize(transcripts.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.floor(turn / CHUNK_TURNS), F.lit(_NO_TURN)).cast("long").alias("chunk"),
        turn.alias("turn"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    # written out: its size tells whether it is broadcast
    full = materialize(
        rows.groupBy(F.col("conv_id").alias("f_conv"), F.col("chunk").alias("f_chunk")).count().where(F.col("count") > CHUNK_ROWS).select("f_conv", "f_chunk"))
    within = F.coalesce(F.col("turn") - F.col("chunk") * CHUNK_TURNS, F.lit(0))
    cut = F.when(F.col("f_chunk").isNotNull(), F.shiftleft(within, _ROW_BITS) + F.floor(F.col("rid") / CHUNK_ROWS)).otherwise(0)
    rows = rows.join(full, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("chunk") == F.col("f_chunk")), "left").select(
        "conv_id", "chunk", cut.cast("long").alias("cut"), "turn", "rid", "text")
    shared = spark.sparkContext.broadcast(model)

    def lines_of(group):
        return [x for row in group for x in row[5].split("\n")]

    def summaries(batches):
        m = shared.value
        for (conv, chunk, at), group in _groups(batches, 3):
            lines = lines_of(group)
            through = _through(m.scores(lines), m.move)
            # whether the line before the chunk was blank is not known here; it moves the first line's scores alone
            other = m.scores(lines[:1], False)[0] - m.scores(lines[:1])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([at], pa.int64()), pa.array([through.ravel().tolist()]), pa.array([other.tolist()]),
                 pa.array([not lines[-1].strip()])],
                ["conv_id", "chunk", "cut", "best", "other", "blank"])

    def ends(batches):
        m = shared.value
        n = len(STATES)
        names = ["e_conv", "e_chunk", "e_cut", "first", "last", "blank"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        conv, now, blank = None, None, True
        path: list = []  # chunk, cut, blank before it, and two small tables of back pointers

        def traced():
            last, out = int(now.argmax()), []
            for chunk, at, before, back, entry in reversed(path):
                first = int(back[last])
                out.append((conv, chunk, at, first, last, before))
                last = int(entry[first]) if entry is not None else last
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[::-1]), kinds)], names)

        for b in batches:
            for key, chunk, at, best, other, empty in zip(*(c.to_pylist() for c in b.columns)):
                if path and key != conv:
                    yield traced()
                    path, now, blank = [], None, True
                conv = key
                best = np.array(best).reshape(n, n)
                if not blank:
                    best = best + np.array(other)[:, None]
                into = None if now is None else now[:, None] + m.move  # last state before, first state of the chunk
                entry = m.start[:, None] + best if into is None else into.max(axis=0)[:, None] + best
                path.append((chunk, at, blank, entry.argmax(axis=0).astype(np.int8), None if into is None else into.argmax(axis=0).astype(np.int8)))
                now, blank = entry.max(axis=0), empty
        if path:
            yield traced()

    def decode(batches):
        m = shared.value
        for (conv, chunk, at), group in _groups(batches, 3):
            lines = lines_of(group)
            first, last, blank = group[0][6:9]
            entry = np.full(len(STATES), -np.inf)
            entry[first] = 0.0
            path = _viterbi(m.scores(lines, blank), m.move, entry, last)[1]
            texts = []
            for i, x in enumerate(lines):
                texts.append(x[features(x, blank if i == 0 else not lines[i - 1].strip())[1]:] if STATES[path[i]][1] else x)
            k = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * k, pa.int64()), pa.array([chunk] * k, pa.int64()), pa.array([at] * k, pa.int64()), pa.array(range(k), pa.int32()),
                 pa.array([STATES[s][0] for s in path]), pa.array([STATES[s][1] for s in path]), pa.array(texts, pa.string())],
                ["conv_id", "chunk", "cut", "line", "role", "starts_turn", "text"])

    place = "conv_id long, chunk long, cut long"
    best = materialize(_chunks(rows).mapInArrow(trimmed(summaries), f"{place}, best array<double>, other array<double>, blank boolean"))
    bounds = best.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "cut").mapInArrow(
        trimmed(ends), "e_conv long, e_chunk long, e_cut long, first int, last int, blank boolean")
    same = F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("chunk") == F.col("e_chunk")) & (F.col("cut") == F.col("e_cut"))
    known = rows.join(bounds, same).select("conv_id", "chunk", "cut", "turn", "rid", "text", "first", "last", "blank")
    return _chunks(known).mapInArrow(trimmed(decode), f"{place}, line int, role string, starts_turn boolean, text string")


def render(lines: DataFrame) -> DataFrame:
    """``(conv_id, chunk, cut, line, role, starts_turn, text, rendered)``: the lines of ``parse`` gathered to canonical turns.

    A turn's text is its lines joined by ``\\n`` without white space at the
    ends; ``rendered`` is the turn as ``<|role|>`` and its text; the place is
    that of its first line. Null texts are skipped. No lines give an empty table.
    """

    def run(batches):
        for (conv, chunk, at), group in _groups(batches, 3):
            turns: list[list] = []
            for _, _, _, line, role, starts, text in group:
                if starts or not turns:
                    turns.append([line, role, bool(starts), []])
                turns[-1][3].append(text or "")
            k = len(turns)
            texts = ["\n".join(t[3]) for t in turns]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * k, pa.int64()), pa.array([chunk] * k, pa.int64()), pa.array([at] * k, pa.int64()), pa.array([t[0] for t in turns], pa.int32()),
                 pa.array([t[1] for t in turns]), pa.array([t[2] for t in turns]), pa.array(texts, pa.string())],
                ["conv_id", "chunk", "cut", "line", "role", "starts_turn", "text"])

    parts = materialize(lines.repartition("conv_id", "chunk", "cut").sortWithinPartitions("conv_id", "chunk", "cut", "line").mapInArrow(
        trimmed(run), "conv_id long, chunk long, cut long, line int, role string, starts_turn boolean, text string"))
    # a chunk's leading lines go to the last turn that starts in a chunk before it, one small row for a chunk
    starts = parts.groupBy("conv_id", "chunk", "cut").agg(F.max(F.when(F.col("starts_turn"), F.col("line"))).alias("line"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk", "cut").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("chunk", "cut", "line")
    before = starts.select(
        F.col("conv_id").alias("b_conv"), F.col("chunk").alias("b_chunk"), F.col("cut").alias("b_cut"),
        F.last(F.when(F.col("line").isNotNull(), own), ignorenulls=True).over(earlier).alias("turn"))
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("chunk") == F.col("b_chunk")) & (F.col("cut") == F.col("b_cut"))
    turns = (
        parts.where("starts_turn").withColumn("turn", own)
        .unionByName(parts.where("not starts_turn").join(before, same).select(*parts.columns, F.coalesce("turn", own).alias("turn")))
        .groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("chunk", "cut", "line", "role", "starts_turn", "text"))).alias("p"))
    )
    text = F.btrim(F.array_join("p.text", "\n"), F.lit(" \t\n\x0b\f\r"))
    head = [F.col("p")[0][c].alias(c) for c in ("chunk", "cut", "line", "role", "starts_turn")]
    return turns.select("conv_id", *head, text.alias("text"), F.concat(F.lit("<|"), F.col("p")[0]["role"], F.lit("|>\n"), text).alias("rendered"))


#: how the query writes speakers into transcripts, by style: text before a turn, for user, assistant and system
_STYLES = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "System: "), ("### User\n", "### Assistant\n", "### System\n"), ("[user] ", "[assistant] ", "[system] "), ("Q: ", "A: ", "Context: "))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table of turns: markers in one of five styles for each
    conversation, and no marker but a blank line before it for a turn in nine."""
    style = F.pmod(F.xxhash64(F.lit(1), "conv_id"), F.lit(len(_STYLES)))
    bare = F.pmod(F.xxhash64(F.lit(2), "conv_id", "turn"), F.lit(9)) == 0
    marker = F.lit("")
    for i, names in enumerate(_STYLES):
        for role, name in zip(("user", "assistant", "system"), names):
            marker = F.when((style == i) & (F.col("role") == role), F.lit(name)).otherwise(marker)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.when(bare, F.concat(F.lit("\n"), text)).otherwise(F.concat(marker, text)).alias("text"))


def labelled(raw: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> the rows that ``fit`` takes: each with the turn before it, met by key."""
    before = raw.select(
        F.col("conv_id").alias("b_conv"), (F.col("turn") + 1).alias("b_turn"), F.col("role").alias("before"), F.col("text").rlike(r"(^|\n)\s*$").alias("blank"))
    return raw.join(before, (F.col("conv_id") == F.col("b_conv")) & (F.col("turn") == F.col("b_turn")), "left").select(
        "role", "before", "text", F.coalesce("blank", F.lit(True)).alias("after_blank"))
