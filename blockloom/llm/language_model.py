"""Hidden Markov language model.

Latent states emit symbols.  The symbols are the ``HEAD`` most frequent training
tokens, the end token, and ``TAIL`` classes of all other tokens (by the shape of
the token).  A tail token's probability is that of its class from the state
times its own share of the class, which doesn't depend on the state:

    log P(text) = forward recursion over symbols + sum over tail tokens of log P(token | class)

so the first part needs only a model of bounded size, and the second is a join
with the counts of all tokens of the corpus.  Each round of Baum-Welch runs over all whole training
documents; training ends when a round raises the likelihood by less than ``TOLERANCE`` (natural logarithm, by token), or after ``ROUNDS``.
A ``head`` that no vocabulary exceeds gives every token emissions of its own.  Each partition adds up its expected counts, and only their sums (states x symbols, states x
states) reach the driver.  The recursion is scaled, hence exact for any length.

Defined cases: a null or empty text is the end token alone; tokens that training
never saw count 0 and are smoothed; without training documents all counts are 0;
an empty table gives an empty result; a null id is folded as the text ``null``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import fold, sliced, texts
from blockloom.session import keep, releasing

HEAD, TAIL, STATES, ROUNDS, TOLERANCE = 50_000, 64, 6, 14, 1e-2
END = b""  # no word is empty, so the empty string stands for the end
FLUSH, CHUNK, SCALED, SALTS = 200_000, 4096, 8, 16


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lowered, in UTF-8, without the end; methods of bytes know ASCII letters and white space only."""
    return text.encode("utf-8", "replace").lower().split()


@lru_cache(maxsize=1 << 16)
def shape(token: bytes) -> int:
    """Tail class of a token: a hash of its ending and whether it has other than plain letters."""
    core = token.decode("utf-8", "replace").rstrip(".,;:!?")
    return zlib.crc32(f"{core[-2:]}{core.isalpha()}".encode("utf-8", "replace")) % TAIL


def count_tokens(docs: DataFrame) -> DataFrame:
    """``token, c`` over ``docs`` (``text``); tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(tokens(text))
                seen[END] += 1
                if len(seen) >= FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """``symbol_of``: head tokens to symbols; symbols from ``len(symbol_of)`` on are tail classes."""

    symbol_of: dict[bytes, int]
    start: np.ndarray
    move: np.ndarray  # from state x to state
    emit: np.ndarray  # symbol x state
    made: dict = field(default_factory=dict, repr=False)

    def scaled(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (state x symbol) by their mean over the states, and its logarithm; a last symbol, -1, is 1 everywhere."""
        if kind not in self.made:
            scale = np.append(self.emit.mean(axis=1), 1)
            along = np.append(self.emit.T, np.ones((len(self.start), 1)), axis=1) / scale
            self.made[kind] = along.astype(kind), np.log(scale)
        return self.made[kind]

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of a text with its end, and its tail tokens."""
        n, tail, out = len(self.symbol_of), [], [*map(self.symbol_of.get, words), self.symbol_of[END]]
        if None in out:
            tail = [w for w, s in zip(words, out) if s is None]
            rest = map(shape, tail)
            out = [n + next(rest) if s is None else s for s in out]
        return np.array(out, np.int32), tail


def symbol_kind(n_symbols: int) -> type:
    """Integers in which symbols are stored, as bytes, which the JVM passes on as they are."""
    return np.uint16 if n_symbols < 1 << 16 else np.int32


def arrays(column: pa.BinaryArray, kind: type) -> list[np.ndarray]:
    """The symbols in the bytes of an Arrow column."""
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def grouped(sequences: list[np.ndarray], most: int = 4096) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Batches of sequences of like length as (their places, symbols by step and -1 beyond their end, lengths), longest first."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        end = at + 1
        while end < len(order) and end - at < most and 4 * len(sequences[order[end]]) >= 3 * longest - 64 and (end - at + 1) * longest <= 800_000:
            end += 1
        part = order[at:end]
        lengths = np.array([len(sequences[i]) for i in part])
        steps = np.full((longest, len(part)), -1, np.int32)
        for j, i in enumerate(part):
            steps[: lengths[j], j] = sequences[i]
        yield part, steps, lengths
        at = end


def forward(model: Model, steps: np.ndarray, lo: int, hi: int, before: np.ndarray | None, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables and emissions (step x state x sequence) of the steps ``lo:hi``, and the logarithm of all scales by sequence.

    ``before`` are the variables of step ``lo - 1``.  Emissions are scaled by their mean over the states, variables to
    a sum of 1 at every ``SCALED`` th step and the last one; the emissions of such a step take over its scale, so that the
    backward recursion on them stays in range too.  As each state can be reached from any other in one step, and a smoothed emission and move are each
    above 1e-15 up to 1e14 tokens, no variable falls under 1e-30 of the step before: 64 bits hold ``SCALED`` such steps.
    Beyond a sequence's end emissions are 1, which moves nothing.
    """
    along, log_scale = model.scaled(kind)
    k, back, start = len(model.start), np.ascontiguousarray(model.move.T, kind), model.start.astype(kind)
    here_steps = np.where(steps[lo:hi] < 0, along.shape[1] - 1, steps[lo:hi]).astype(np.intp)
    emitted = np.empty((hi - lo, k, steps.shape[1]), kind)
    for j in range(k):
        emitted[:, j] = np.take(along[j], here_steps)
    logs, alpha, a = np.take(log_scale, here_steps).sum(axis=0), np.empty_like(emitted), before
    for i in range(hi - lo):
        here = alpha[i]
        if a is None:
            here[:] = start[:, None]
        else:
            np.dot(back, a, out=here)
        here *= emitted[i]
        if i % SCALED == SCALED - 1 or i == hi - lo - 1:
            s = here.sum(axis=0)
            here /= s
            emitted[i] /= s
            logs += np.log(s)
        a = here
    return alpha, emitted, logs


def likelihood(model: Model, steps: np.ndarray, lengths: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Natural logarithm of each sequence's likelihood by the scaled forward recursion; keeps one chunk of steps."""
    total, before = np.zeros(steps.shape[1]), None
    for lo in range(0, len(steps), chunk):
        alpha, _, logs = forward(model, steps, lo, min(lo + chunk, len(steps)), before)
        total += logs
        before = alpha[-1]
    return total


def expected(model: Model, sequences: list[np.ndarray], chunk: int = CHUNK, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions (the E step) over whole sequences, and the logarithm of their likelihood.

    Long sequences are held ``chunk`` steps at a time: the forward variables before each chunk are kept, and the chunk's
    own are computed again when the backward pass, which carries on across chunks, gets there.
    """
    k, move = len(model.start), model.move.astype(kind)
    start, moves, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit) + 1, k)), 0.0
    for _, steps, lengths in grouped(sequences):
        cuts = [*range(0, len(steps), chunk), len(steps)]
        before: list[np.ndarray | None] = [None]
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            before.append(forward(model, steps, lo, hi, before[-1], kind)[0][-1])
        later = np.ones((k, steps.shape[1]), kind)
        for lo, hi, first in reversed([*zip(cuts[:-1], cuts[1:], before)]):
            alpha, ahead, logs = forward(model, steps, lo, hi, first, kind)
            total += logs.sum()
            betas = np.empty_like(alpha)
            for i in range(hi - lo - 1, -1, -1):
                betas[i] = later
                ahead[i] *= later
                if i or first is not None:
                    np.dot(move, ahead[i], out=later)
            ahead *= (steps[lo:hi] >= 0)[:, None]
            moves += np.matmul(alpha[:-1], ahead[1:].transpose(0, 2, 1)).sum(axis=0)
            if first is not None:
                moves += first @ ahead[0].T
            alpha *= betas
            if lo == 0:
                start += alpha[0].sum(axis=1)
            flat = np.where(steps[lo:hi] < 0, len(model.emit), steps[lo:hi]).astype(np.intp).ravel()
            for j in range(k):
                emit[:, j] += np.bincount(flat, weights=alpha[:, j].ravel(), minlength=len(emit))
    if not (np.isfinite(total) and np.isfinite(moves).all() and np.isfinite(emit).all()):
        raise FloatingPointError("the expected counts aren't finite")
    return start, moves * model.move, emit[:-1], total


def maximised(symbol_of: dict[bytes, int], start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
    """The M step; emissions are smoothed towards the unigram distribution."""
    e = emit + 20.0 * unigram[:, None] + 1e-9
    m = move + 1.0
    return Model(symbol_of, (start + 1) / (start + 1).sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def initial(symbol_of: dict[bytes, int], unigram: np.ndarray, states: int, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    emit = (unigram[:, None] + 1e-9) * rng.gamma(1.0, 1.0, (len(unigram), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Model(symbol_of, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def sums_of_counts(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts and log-likelihood of all ``docs``, added up by block: inside each task, then over ``SALTS`` groups of tasks, then over the groups."""
    k, n_symbols = len(model.start), len(model.emit)
    plain, kind = Model({}, model.start, model.move, model.emit), symbol_kind(n_symbols)
    names = ["block", "salt", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros((n_symbols, k)), 0.0]
        for b in batches:
            sums = [x + y for x, y in zip(sums, expected(plain, arrays(b.column("symbols"), kind)))]
        flat, salt = np.concatenate([np.ravel(x) for x in sums]), TaskContext.get().partitionId() % SALTS
        for i in range(0, len(flat), 1024):
            yield pa.RecordBatch.from_arrays([pa.array([i // 1024], pa.int32()), pa.array([salt], pa.int32()), pa.array([flat[i : i + 1024].tobytes()], pa.binary())], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for block, salt, part in zip(*(b.column(c).to_pylist() for c in names)):
                sums[block, salt] = sums.get((block, salt), 0) + np.frombuffer(part, np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sums], pa.int32()), pa.array([x for _, x in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=names)

    schema = "block int, salt int, part binary"
    grouped_sums = docs.mapInArrow(run, schema).repartition("block", "salt").mapInArrow(total, schema).withColumn("salt", F.lit(0))
    with releasing(docs.sparkSession):
        rows = grouped_sums.repartition("block").mapInArrow(total, schema).collect()  # one row for each block
    flat = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(k + k * k + n_symbols * k + 1)
    return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(n_symbols, k), float(flat[-1])


def score(docs: DataFrame, states: int = STATES, head: int = HEAD, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Base and model scores of every document; learns from those whose crc32(id) mod 5 is not 1."""
    rows = texts(docs).withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    spark = docs.sparkSession
    counts = keep(count_tokens(rows.where(~F.col("held_out"))), "counts")
    sizes = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(sizes["n"]), int(sizes["v"])
    # the head: all tokens of the highest frequency classes (eighths of an octave) that fit
    octave = F.floor(F.log2(F.col("c")) * 8).cast("int")
    least, room = 1 << 30, head
    for r in sorted(counts.where(F.length("token") > 0).groupBy(octave.alias("o")).count().collect(), key=lambda r: -r["o"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["o"]
    best = sorted(counts.where((F.length("token") > 0) & (octave >= least)).collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    symbol_of = {bytes(r["token"]): i for i, r in enumerate(best)} | {END: len(best)}
    n_head = len(symbol_of)
    ends = counts.where(F.length("token") == 0).first()
    head_counts = np.array([r["c"] for r in best] + [ends["c"] if ends else 0], float)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
        for b in batches:
            for token, c in zip(b.column("token").to_pylist(), b.column("c").to_pylist()):
                if token not in symbol_of:
                    s = shape(token)
                    n[s] += c
                    v[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL), pa.int32()), pa.array(n), pa.array(v)], names=["cls", "n", "v"])

    tail = counts.mapInArrow(classes, "cls int, n bigint, v bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for r in tail:
        tail_n[r["cls"]], tail_v[r["cls"]] = r["n"], r["v"]
    unigram = np.concatenate([head_counts + 0.5, tail_n + 0.5 * (tail_v + 1)])
    unigram /= unigram.sum()
    probe = Model(symbol_of, np.ones(1), np.ones((1, 1)), unigram[:, None])
    known, kind = np.log10(head_counts + 0.5), symbol_kind(len(unigram))
    tail_scale = np.log10(tail_n + 0.5 * (tail_v + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2_500):
            out = [probe.symbols(tokens(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([s.astype(kind).tobytes() for s, _ in out], pa.binary()), pa.array([t for _, t in out], pa.list_(pa.binary()))],
                names=["doc_id", "held_out", "symbols", "tail"],
            )

    # uid tells repeated ids apart; the stored table fixes it
    seen = keep(rows.mapInArrow(read, "doc_id bigint, held_out boolean, symbols binary, tail array<binary>").withColumn("uid", F.monotonically_increasing_id()), "symbols")
    training = seen.where(~F.col("held_out")).select("symbols")

    model = initial(symbol_of, unigram, states)
    before = None
    for _ in range(rounds):
        *sums, likely = sums_of_counts(training, model)
        model = maximised(symbol_of, *sums, unigram)
        if before is not None and likely - before < tolerance * max(sums[2].sum(), 1):
            break
        before = likely
    plain = Model({}, model.start, model.move, model.emit)  # scoring needs no tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequences = arrays(b.column("symbols"), kind)
            ll = np.zeros(len(sequences))
            for part, steps, lengths in grouped(sequences):
                ll[part] = likelihood(plain, steps, lengths) / np.log(10)
            base, own, in_head = [], [], []
            for s in sequences:
                h = s[s < n_head]
                base.append(float(known[h].sum()))
                in_head.append(int((head_counts[h] > 0).sum()))
                own.append(float(-tail_scale[s[s >= n_head].astype(np.int64) - n_head].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("doc_id"), b.column("held_out"), pa.array([len(s) for s in sequences], pa.int64()), pa.array(in_head, pa.int64()), pa.array(base, pa.float64()), pa.array(ll + np.array(own), pa.float64())],
                names=["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"],
            )

    heads = seen.select("uid", "doc_id", "held_out", "symbols").mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, head_score double")
    # tail tokens meet their counts; they are rare by construction, and one row per document and token is sent
    spread = seen.select("uid", F.explode("tail").alias("token"))
    met = spread.join(counts, "token", "left").groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.count("c").alias("tail_known"))
    norm = float(np.log10(n_all + 0.5 * (v_all + 1)))
    got, known_tail = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    return heads.join(met, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + known_tail).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_base") + got - F.col("n_tokens") * norm).alias("base_score"), (F.col("head_score") + got).alias("score"),
    )
