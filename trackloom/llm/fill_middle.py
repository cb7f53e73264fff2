"""Fill-in-middle transformation, with the cuts found by a parallel automaton scan.

A text's units are its runs of ASCII letters and its other single characters. A four-state automaton counts them and the
marks in the text. Texts are cut into lanes, and texts longer than a chunk into chunks that different tasks read. A
lane (or chunk) does not know its entry state, so it gives its whole transition function: for each start state the end
state, the units and the marks. Functions compose associatively: a segmented prefix scan over lanes and a fold over
chunks resolve every entry state. A cut is then selected by the counts: first its chunk, then its lane, and only that
lane is walked again.

Edge cases: null text counts as empty (plain, no units); a null doc_id draws as the empty string does; equal rows have
equal results; a text may have any length up to Spark's 2 GB, as only a chunk at a time is in code points, while its
result is one string in one row; an empty table gives no rows; other columns pass through, and one that has a result
column's name is replaced (names that begin with `_fm_` are reserved).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import shared

#: code points of a chunk, the most one task scans of a text at a time, and of a lane
CHUNK, LANE = 65_536, 256
# The marks of prefix, suffix and middle; of a hundred texts those that stay plain and, of the rest, those that are suffix first.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SUFFIX_FIRST = 90, 20

# Classes of characters: none (fills a lane up), other, letter, letter of a mark, "<", ">". States: between words, in a
# word, behind "<", behind "<" and a mark's letter.
_STATES, _CLASSES = 4, 6
_CLASS = np.ones(129, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[[ord(m[1]) for m in MARKS]] = 3
_CLASS[[ord("<"), ord(">")]] = 4, 5
_NEXT = np.array([[s, 0, 1, 3 if s == 2 else 1, 2, 0] for s in range(_STATES)], np.int64)
_BEGINS = np.array([[0, 1, s in (0, 2), s in (0, 2), 1, 1] for s in range(_STATES)], np.int64)
_MARK = np.array([[0, 0, 0, 0, 0, s == 3] for s in range(_STATES)], np.int64)
# one step looks both up at once: rows are states times classes, and a mark counts in the upper half of what a step adds
_STEP_NEXT, _STEP_ADDS = (_NEXT * _CLASSES).ravel(), (_BEGINS + (_MARK << 32)).ravel()


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The function of reading one piece and then another: (end states, what is counted), each by start state."""
    ends, counts = first
    return np.take_along_axis(then[0], ends, 1), counts + np.take_along_axis(then[1], ends, 1)


class Scan:
    """The transition functions of texts, lane by lane."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lanes = np.maximum(1, -(-self.sizes // LANE))
        self.last = np.cumsum(lanes) - 1
        self.first = self.last - lanes + 1
        codes = np.zeros(int(lanes.sum()) * LANE, np.uint8)
        gaps = np.repeat(self.first * LANE - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        codes[np.arange(len(points)) + gaps] = _CLASS[np.minimum(points, 128)]
        self.codes = codes.reshape(-1, LANE)
        self.prefix = self._prefixes(self._lanes(), np.repeat(self.first, lanes))

    def _lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """Every lane's function: all lanes advance together, from all start states at once."""
        states = np.repeat(np.arange(_STATES)[:, None] * _CLASSES, len(self.codes), 1)
        counts = np.zeros_like(states)
        for column in np.ascontiguousarray(self.codes.T):
            states += column
            counts += _STEP_ADDS.take(states)
            states = _STEP_NEXT.take(states)
        return np.ascontiguousarray(states.T) // _CLASSES, np.ascontiguousarray(counts.T)

    @staticmethod
    def _prefixes(lanes: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every lane the function of its text up to the lane's end: a prefix scan that doubles its reach."""
        (ends, counts), at, reach = lanes, np.arange(len(first)), 1
        while len(met := np.flatnonzero(at - reach >= first)):
            before = met - reach
            ends_of, counts_of = compose((ends[before], counts[before]), (ends[met], counts[met]))
            ends, counts = ends.copy(), counts.copy()
            ends[met], counts[met] = ends_of, counts_of
            reach *= 2
        return ends, counts

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every text and start state: end state, units that begin, marks that end."""
        ends, counts = self.prefix[0][self.last], self.prefix[1][self.last]
        return ends, counts & 0xFFFFFFFF, counts >> 32

    def places(self, texts: np.ndarray, entries: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Where the given unit (from 0) of each text begins, in code points; the text's size if it has no such unit."""
        lanes, state = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        left = np.empty(len(texts), np.int64)
        for i, (text, entry, unit) in enumerate(zip(texts, entries, units, strict=True)):
            first, last = self.first[text], self.last[text]
            done = self.prefix[1][first : last + 1, entry] & 0xFFFFFFFF
            k = min(int(np.searchsorted(done, unit, "right")), last - first)
            lanes[i], left[i] = first + k, unit - (done[k - 1] if k else 0)
            state[i] = self.prefix[0][first + k - 1, entry] if k else entry
        found, state = np.full(len(texts), -1), state * _CLASSES
        for j, column in enumerate(np.ascontiguousarray(self.codes[lanes].T)):
            state = state + column
            begins = _STEP_ADDS.take(state) & 0xFFFFFFFF
            found[(begins == 1) & (left == 0)] = j
            left = left - begins
            state = _STEP_NEXT.take(state)
        return np.where(found < 0, self.sizes[texts], (lanes - self.first[texts]) * LANE + found)


def draws(doc_id: object, seed: str) -> tuple[int, int, int, int]:
    """Four numbers that depend on the seed and the document alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def shape(doc_id: object, seed: str, units: int, marks: int) -> tuple[str, int, int]:
    """The form, and after how many units prefix and middle end."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not units or marks or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    cuts = sorted((h1 % (units + 1), h2 % (units + 1)))
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", *cuts


def arranged(text: str, form: str, a: int, b: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = MARKS[0] + text[:a], MARKS[2] + text[a:b], MARKS[1] + text[b:]
    return suffix + prefix + middle if form == "spm" else prefix + suffix + middle


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = MARKS

    def between(start: str, end: str | None) -> Column:
        behind = F.substring(output, F.locate(start, output) + len(start), F.length(output))
        return F.substring_index(behind, end, 1) if end else behind

    middle = between(m, None)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


_RESULT = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def _answered(batch: pa.RecordBatch, keep: int, rows: list[tuple]) -> pa.RecordBatch:
    """A batch's first `keep` columns with its results."""
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(c, k) for c, k in zip(columns, _RESULT.values(), strict=True))], [*batch.schema.names[:keep], *_RESULT])


def _row(text: str, units: int, form: str, a: int, b: int) -> tuple:
    return (units, form, *((None, None) if form == "plain" else (a, b - a)), arranged(text, form, a, b))


def _short(docs: DataFrame, seed: str, schema: str) -> DataFrame:
    """Texts of at most a chunk: one batch's texts are scanned together."""

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            scan = Scan(texts)
            _, units, marks = (f[:, 0] for f in scan.functions())
            shapes = [shape(i, seed, int(u), int(m)) for i, u, m in zip(ids, units, marks, strict=True)]
            cut = np.array([k for k, (form, _, _) in enumerate(shapes) if form != "plain"], np.int64)
            zeros = np.zeros_like(cut)
            ends = [dict(zip(cut.tolist(), scan.places(cut, zeros, np.array([shapes[k][side] for k in cut], np.int64)).tolist(), strict=True)) for side in (1, 2)]
            yield _answered(batch, batch.num_columns, [_row(t, int(units[k]), shapes[k][0], ends[0].get(k, 0), ends[1].get(k, 0)) for k, t in enumerate(texts)])

    return docs.mapInArrow(run, schema)


def _long(docs: DataFrame, seed: str, chunk: int, schema: str) -> DataFrame:
    """Longer texts: chunks are dealt over tasks, their functions composed a text, and each cut's chunk alone is read again."""
    rows = shared.staged(docs.withColumn("_fm_row", F.monotonically_increasing_id()), "long_texts")

    @shared.trimming
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"_fm_row": pa.int64(), "_fm_chunk": pa.int32(), "piece": pa.string()}
        pieces = ((row, at // chunk, text[at : at + chunk]) for batch in batches for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for text in [value.as_py()] for at in range(0, len(text), chunk))
        yield from shared.arrow_rows(pieces, kinds)

    @shared.trimming
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in batches:
            if batch.num_rows:
                found = Scan(batch.column(2).to_pylist()).functions()
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(f.tolist(), k) for f, k in zip(found, lists, strict=True))], ["_fm_row", "_fm_chunk", "ends", "units", "marks"])

    pieces = rows.select("_fm_row", "text").mapInArrow(cut, "_fm_row long, _fm_chunk int, piece string")
    # a text's chunks go to different tasks, so one giant text does not hold one task up
    functions = shared.staged(pieces.repartition("_fm_row", "_fm_chunk").mapInArrow(scanned, "_fm_row long, _fm_chunk int, ends array<int>, units array<long>, marks array<long>"), "chunk_functions")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's units and marks, and for each cut its chunk, the entry state there and the unit within it."""
        kinds = {"_fm_row": pa.int64(), "n": pa.int64(), "form": pa.string()} | {f"{what}{i}": pa.int64() for i in (1, 2) for what in ("chunk", "entry", "unit")}

        def chosen(row: int, doc_id: object, entries: list[int], done: list[int], marks: int) -> tuple:
            form, *cuts = shape(doc_id, seed, done[-1], marks)
            picked = []
            for unit in cuts:
                k = min(int(np.searchsorted(done, unit, "right")) - 1, len(entries) - 1)
                picked += [k, entries[k], unit - done[k]]
            return row, done[-1], form, *picked

        def texts() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for row, doc_id, ends, units, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is None or held[0] != row:
                        if held:
                            yield chosen(*held[:5])
                        held = [row, doc_id, [], [0], 0, 0]
                    state = held[5]
                    held[2].append(state)
                    held[3].append(held[3][-1] + units[state])
                    held[4] += found[state]
                    held[5] = ends[state]
            if held:
                yield chosen(*held[:5])

        yield from shared.arrow_rows(texts(), kinds)

    # a chunk's function is a hundred bytes, and a text of 2 GB has 32,768 of them
    ordered = functions.join(rows.select("_fm_row", "doc_id"), "_fm_row").repartition("_fm_row").sortWithinPartitions("_fm_row", "_fm_chunk")
    cuts = shared.staged(ordered.select("_fm_row", "doc_id", "ends", "units", "marks").mapInArrow(resolved, "_fm_row long, n long, form string, chunk1 long, entry1 long, unit1 long, chunk2 long, entry2 long, unit2 long"), "text_cuts")

    keep = len(docs.columns)

    @shared.trimming
    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, form, *picked = (batch.column(batch.schema.get_field_index(f"_fm_{c}")).to_pylist() for c in ("n", "form", "chunk1", "entry1", "unit1", "chunk2", "entry2", "unit2"))
            out = []
            for k, value in enumerate(batch.column(batch.schema.get_field_index("text"))):
                text, ends = value.as_py(), [0, 0]
                if form[k] != "plain":
                    at = [picked[0][k] * chunk, picked[3][k] * chunk]
                    scan = Scan([text[a : a + chunk] for a in at])
                    within = scan.places(np.arange(2), np.array([picked[1][k], picked[4][k]]), np.array([picked[2][k], picked[5][k]]))
                    ends = [a + int(w) for a, w in zip(at, within, strict=True)]
                out.append(_row(text, n[k], form[k], *ends))
            yield _answered(batch, keep, out)

    named = cuts.select("_fm_row", *[F.col(c).alias(f"_fm_{c}") for c in cuts.columns[1:]])
    met = rows.join(shared.sized(named, shared.BROADCAST_ROWS // 4), "_fm_row")
    return met.select(*docs.columns, *named.columns[1:]).mapInArrow(assembled, schema)


def fill_in_middle(docs: DataFrame, seed: str = "1", chunk: int = CHUNK) -> DataFrame:
    """The rows of docs (doc_id, text and others) with n, form, prefix_chars, middle_chars and the output text."""
    kept = docs.select(*[c for c in docs.columns if c not in _RESULT])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n long, form string, prefix_chars long, middle_chars long, output string"])
    size = F.coalesce(F.length("text"), F.lit(0))
    return _short(kept.where(size <= chunk), seed, schema).unionByName(_long(kept.where(size > chunk), seed, chunk, schema))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rebuilt = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || doc_id) AS h FROM documents),
d AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
