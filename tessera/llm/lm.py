"""Language-model scores: a gated recurrent network in numpy with a class-factored output.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts come from all training documents, by
partial counts in the tasks and one aggregation by token. The network knows numbers, reads one per token and
predicts the next one in two steps, its class and the number within it, both softmaxes of its state:

* the ``HEAD`` most frequent tokens have numbers of their own, in classes of ``PER_CLASS`` by frequency;
* every other token shares a number, a bucket of a class by its ending; the classes grow with the square root
  of the vocabulary. Within a bucket a token has its share of the bucket's counts, each plus one, with one
  unknown token.

Before training, the biases make the network the unigram model of all counts. It is trained by truncated
backpropagation (windows of ``WINDOW`` tokens, the state carried from window to window) on passages from every
part of all training documents: a document is cut into passages of ``PASSAGE`` tokens, and every one of them is
learnt, with the window before it read but not learnt; no token is left out and none is learnt twice. Passages are
dealt over ``ROUNDS`` rounds by a hash of their tokens and place; in a round tasks train side by side from the same
parameters, which are then averaged by the number of tokens.

A document is scored whole: its state is carried through all of its windows.

The logarithms of a document's counts need every token's count. The most frequent tokens, ``MAPPED`` at most, are
sent to all tasks; a document's other tokens are joined with the counts by a shuffle. Those tokens are rare by
choice, so no key of that join is hot.

Defined results: null text is the empty text, whose one token is the end; rows with a null id are scored and
not learned from; with nothing to learn from, N and V are zero and the network stays as it began; repeated
rows get repeated results; other columns are never read.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common

HEAD, PER_CLASS, UNITS, WINDOW = 2000, 50, 32, 16
#: Classes of shared numbers at least.
LEAST_TAILS = 8
#: Tokens that are sent to all tasks at most, and the bytes of the longest of them.
MAPPED, LONGEST = 200_000, 256
#: Tokens of a passage, how many passages there are to one that is learnt (one: all are), and the rounds they are dealt over.
PASSAGE, EVERY, ROUNDS = 128, 1, 2
#: Passages trained side by side, and those sorted by length together.
STREAMS, SORTED = 512, 16384
#: Tokens that a task learns from in a round, as long as MOST_TASKS of them are enough.
TASK_TOKENS, MOST_TASKS = 1 << 21, 2048
#: Rows of one number that are added up across numbers; the rest of a frequent number's is summed by itself.
TIMES = 20
#: The step size, and the steps over which it rises to that.
RATE, WARM = 0.02, 16
#: Counts of tokens that a task holds before it adds up equal ones; beyond half of this it passes them on.
HELD = 400_000
#: Documents scored side by side, tokens of each in one step of the output layer, and documents that a task takes together.
SIDE, STEPS, GATHER = 512, 16, 4096
#: Tokens of documents that are scored together at least, unless a task has fewer.
SCORED = 1 << 20
#: States that pass through the output layers together, so that they stay in the processor's cache.
BLOCK = 4096


def tokens_of(text: str | None) -> list[bytes]:
    """A text's tokens; the end is the empty one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    return words


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts as ``tokens_of`` gives them, one after the other, and how many each text has."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # a blank at the end leaves an empty word there: the end
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), "", pc.binary_join_element_wise(bare, "", " ")))
    return found.flatten().cast(pa.binary()), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "__text") -> Iterator[pa.RecordBatch]:
    """Slices of batches put together, up to ``GATHER`` rows and the bytes of one slice."""
    held, rows, size = [], 0, 0
    for batch in common.cuts(batches, text):
        more = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
        if held and (rows + batch.num_rows > GATHER or size + more > common.SLICE_CHARS):
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + more
    if held:
        yield pa.concat_batches(held)


def tails_of(types: int) -> int:
    """Classes of shared numbers for a vocabulary."""
    return max(LEAST_TAILS, -(-int(np.sqrt(types)) // PER_CLASS))


def bucket(token: bytes, tails: int) -> int:
    """The shared number of a token, from zero: a class by its ending, and a place in it."""
    return zlib.crc32(token[-3:]) % tails * PER_CLASS + (zlib.crc32(token) >> 8) % PER_CLASS


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token binary, c long) over all rows of ``docs``, as a table in the shared folder."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "c"]
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).select(["token", "c_sum"]).rename_columns(names)

        def flush() -> Iterator[pa.RecordBatch]:
            yield from merged().to_batches(max_chunksize=50_000)
            held.clear()

        for batch in gathered(batches):
            found = split(batch.column(0))[0].value_counts()
            held.append(pa.table([found.field(0), found.field(1)], names))
            if sum(map(len, held)) > HELD:
                held[:] = [merged()]
                if len(held[0]) > HELD / 2:
                    yield from flush()
        if held:
            yield from flush()

    partial = docs.select(F.col(text).alias("__text")).mapInArrow(run, "token binary, c long")
    return common.materialise(partial.groupBy("token").agg(F.sum("c").alias("c")), "counts")


def keep_memory() -> None:
    """Lets the C library keep freed memory of arrays up to 16 MB, where it is glibc: a training step takes and frees the same megabytes thousands of times."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def exponentials(logits: Callable[[], np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of each row of logits, their sums, and the logits at the places ``chosen``; rows are shifted where the range of 32-bit numbers asks for it."""
    x = logits()
    at, ones = x[np.arange(len(x)), chosen], np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore"):
        sums = np.exp(x, out=x) @ ones
    if len(x) and not (sums.min() > 1e-30 and sums.max() < 1e30):
        x = logits()
        top = x.max(-1, keepdims=True)
        x -= top
        at -= top[:, 0]
        sums = np.exp(x, out=x) @ ones
    return x, sums, at


def ordered(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of numbers below ``most``, the distinct ones, and where each begins and how often it occurs in that order."""
    counts = np.bincount(x, minlength=most)
    found = np.flatnonzero(counts)
    counts = counts[found]
    # short numbers are sorted by their digits
    return np.argsort(x.astype(np.uint16) if most <= 1 << 16 else x, kind="stable"), found, np.cumsum(counts) - counts, counts


def summed(rows: np.ndarray, order: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of the rows of each value that ``ordered`` found."""
    by_count = np.argsort(-counts, kind="stable")
    first, falling = first[by_count], -counts[by_count]
    out = rows[order[first]]
    for k in range(1, TIMES):  # the second rows of all values that have one, the third ones, and so on
        n = int(np.searchsorted(falling, -k))
        if not n:
            break
        out[:n] += rows[order[first[:n] + k]]
    for i in range(int(np.searchsorted(falling, -TIMES))):
        out[i] += rows[order[first[i] + TIMES : first[i] - falling[i]]].sum(0)
    found = np.empty_like(out)
    found[by_count] = out
    return found


class Network:
    """The gated recurrent network over numbers, with its two output layers."""

    def __init__(self, heads: int, tails: int = LEAST_TAILS, masses: np.ndarray | None = None, seed: int = 11) -> None:
        self.heads, self.head_classes, self.tails = heads, -(-heads // PER_CLASS), tails
        #: The first shared number, the number before a text, and the number of classes.
        self.shared, classes = self.head_classes * PER_CLASS, self.head_classes + tails
        self.start = classes * PER_CLASS
        u, rng = UNITS, np.random.default_rng(seed)
        make = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "input": make(0.1, self.start + 1, 3 * u), "state": make(0.1, u, 3 * u), "cls": make(0.01, u, classes), "cls_b": np.zeros(classes, np.float32),
            "word": make(0.01, classes, u, PER_CLASS), "word_b": np.zeros((classes, PER_CLASS), np.float32),
        }
        if masses is not None:
            by_class = masses.reshape(classes, PER_CLASS)
            self.p["cls_b"][:] = np.log(by_class.sum(1) + 1)
            self.p["word_b"][:] = np.log(by_class + 1)
        self.p["word_b"].reshape(-1)[heads : self.shared] = -1e9  # places of the last head class that no token has

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in self.p.values())

    def unpack(self, raw: bytes) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = np.frombuffer(raw, np.float32, x.size, at).reshape(x.shape).copy()
            at += 4 * x.size

    def forward(self, h: np.ndarray, ids: np.ndarray, keep: np.ndarray | None = None):
        """The state before ``ids`` (time, streams) and after each, the gates with the candidate (time, 3, streams, units) and the candidate's own part."""
        u, (n, lanes), state = UNITS, ids.shape, self.p["state"]
        own = state.reshape(u, 3, u).transpose(1, 0, 2).copy()
        own[:2] *= 0.5  # a sigmoid is a hyperbolic tangent of half its argument
        parts = ids[:, None] * 3 + np.arange(3)[:, None]
        gates = np.take(self.p["input"].reshape(-1, u), parts, axis=0)
        gates[:, :2] *= 0.5
        states, linear = np.empty((n + 1, lanes, u), state.dtype), np.empty((n, lanes, u), state.dtype)
        states[0] = h
        product = np.empty((3, lanes, u), state.dtype)
        for t in range(n):
            h, z_r, new, after = states[t], gates[t, :2], gates[t, 2], states[t + 1]
            if keep is not None:
                h = h * keep[t][:, None]
            np.matmul(h, own[:2], out=product[:2])
            np.matmul(h, own[2], out=linear[t])
            z_r += product[:2]
            np.tanh(z_r, out=z_r)
            z_r *= 0.5
            z_r += 0.5
            np.multiply(linear[t], z_r[1], out=product[2])
            new += product[2]
            np.tanh(new, out=new)
            np.subtract(h, new, out=after)
            after *= z_r[0]
            after += new
        return states, gates, linear

    def step(self, h: np.ndarray, ids: np.ndarray):
        """The state after one number each, alone in a tuple."""
        return (self.forward(h, ids[None])[0][-1],)

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(class) P(number in class)."""
        out = np.empty(len(h))
        for start in range(0, len(h), BLOCK):
            flat, goal = h[start : start + BLOCK], targets[start : start + BLOCK]
            own = goal // PER_CLASS
            _, sums, at = exponentials(lambda: self.classes(flat), own)  # noqa: B023
            found, totals = at.astype(np.float64), sums.astype(np.float64)
            order, classes, first, counts = ordered(own, len(self.p["cls_b"]))
            flat, place, own = flat[order], (goal - own * PER_CLASS)[order], own[order]
            _, sums, at = exponentials(lambda: self.words(flat, own, classes, first, counts), place)  # noqa: B023
            found[order] += at
            totals[order] *= sums
            out[start : start + BLOCK] = found - np.log(totals)
        return out

    def classes(self, flat: np.ndarray) -> np.ndarray:
        """The logits of the classes."""
        x = flat @ self.p["cls"]
        x += self.p["cls_b"]
        return x

    def words(self, flat: np.ndarray, own: np.ndarray, classes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The logits within their classes of states sorted by class."""
        word, x = self.p["word"], np.empty((len(flat), PER_CLASS), self.p["word"].dtype)
        for k, a, n in zip(classes.tolist(), first.tolist(), counts.tolist(), strict=True):
            np.matmul(flat[a : a + n], word[k], out=x[a : a + n])
        x += self.p["word_b"][own]
        return x

    def gradients(self, h: np.ndarray, ids: np.ndarray, targets: np.ndarray, keep: np.ndarray | None, weight: np.ndarray):
        """Gradients of a window (time, streams), the numbers whose inputs' gradients those are, and the state after it; ``keep`` is 0 where a document starts (None: it never is), ``weight`` 0 where nothing is learnt."""
        u, p = UNITS, self.p
        states, gates, linear = self.forward(h, ids, keep)
        before, after = states[:-1] if keep is None else states[:-1] * keep[:, :, None], states[1:]
        kind, every = states.dtype, after.reshape(-1, u)
        # only states that something is learnt from reach the output layers
        real = np.flatnonzero(weight)
        whole = len(real) == len(every)
        flat, goal = (every, targets.ravel()) if whole else (every[real], targets.ravel()[real])
        w = (weight.ravel()[real] / max(1.0, float(weight.sum()))).astype(kind)
        own = goal // PER_CLASS
        order, classes, first, counts = ordered(own, len(p["cls_b"]))
        flat, own, goal, w = flat[order], own[order], goal[order], w[order]
        rows, ones, g = np.arange(len(flat)), np.ones(len(flat), kind), {"word": np.empty_like(p["word"]), "word_b": np.empty_like(p["word_b"])}
        if len(classes) < len(p["cls_b"]):
            unread = np.setdiff1d(np.arange(len(p["cls_b"])), classes, assume_unique=True)
            g["word"][unread], g["word_b"][unread] = 0, 0

        def errors(logits: Callable[[], np.ndarray], chosen: np.ndarray) -> np.ndarray:
            x, sums, _ = exponentials(logits, chosen)
            x *= (w / sums)[:, None]
            x[rows, chosen] -= w
            return x

        error = errors(lambda: self.classes(flat), own)
        g["cls"], g["cls_b"] = flat.T @ error, ones @ error
        back = error @ p["cls"].T
        error = errors(lambda: self.words(flat, own, classes, first, counts), goal - own * PER_CLASS)
        product = np.empty_like(back)
        for k, a, n in zip(classes.tolist(), first.tolist(), counts.tolist(), strict=True):
            e = error[a : a + n]
            np.matmul(flat[a : a + n].T, e, out=g["word"][k])
            np.matmul(ones[:n], e, out=g["word_b"][k])
            np.matmul(e, p["word"][k].T, out=product[a : a + n])
        back += product
        down = np.empty_like(every) if whole else np.zeros_like(every)
        down[order if whole else real[order]] = back
        down = down.reshape(after.shape)
        # the factors of dz, dn and dr for all times, then the chain of states
        z, r, new = gates[:, 0], gates[:, 1], gates[:, 2]
        by_z, by_n, by_r = before - new, 1 - z, 1 - r
        by_z *= z
        by_z *= by_n
        by_n *= 1 - new * new
        by_r *= r
        by_r *= linear
        # columns: dn * r, dz, dr, dn
        parts = np.empty((*ids.shape, 4 * u), kind)
        turned = np.concatenate([p["state"][:, 2 * u :], p["state"][:, : 2 * u]], 1).T.copy()
        carried, dn = np.zeros(h.shape, kind), np.empty(h.shape, kind)
        for t in range(len(ids) - 1, -1, -1):
            d, part = down[t], parts[t]
            d += carried
            np.multiply(d, by_n[t], out=dn)
            np.multiply(dn, r[t], out=part[:, :u])
            np.multiply(d, by_z[t], out=part[:, u : 2 * u])
            np.multiply(dn, by_r[t], out=part[:, 2 * u : 3 * u])
            part[:, 3 * u :] = dn
            np.matmul(part[:, : 3 * u], turned, out=carried)
            d *= z[t]
            carried += d
            if keep is not None:
                carried *= keep[t][:, None]
        parts = parts.reshape(-1, 4 * u)
        g["state"] = before.reshape(-1, u).T @ parts[:, : 3 * u]
        g["state"] = np.concatenate([g["state"][:, u:], g["state"][:, :u]], 1)
        order, read, first, counts = ordered(ids.ravel(), self.start + 1)
        g["input"] = summed(parts[:, u:], order, first, counts)
        return g, read, states[-1]

    def learn(self, passages: Iterator[tuple[np.ndarray, int]], rate: float = RATE, streams: int = STREAMS) -> int:
        """Adam over windows of passages (numbers, how many of them are read only), ``streams`` side by side; the number of tokens learnt."""
        # sums of gradients and of their squares, not means: the moments are a tenth and a hundredth of them
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        n = learnt = 0
        passages = iter(passages)
        while held := sorted(islice(passages, SORTED), key=lambda x: len(x[0])):
            # short and long ones take turns
            for first in np.random.default_rng(n).permutation(-(-len(held) // streams)) * streams:
                own = held[first : first + streams]
                steps = -(-max(len(x) for x, _ in own) // WINDOW) * WINDOW
                ids, goals = np.full((steps, len(own)), self.start), np.zeros((steps, len(own)), np.int64)
                weight = np.zeros((steps, len(own)), np.float32)
                for lane, (x, read) in enumerate(own):
                    ids[1 : len(x), lane], goals[: len(x), lane], weight[read : len(x), lane] = x[:-1], x, 1
                learnt += int(weight.sum())
                h = np.zeros((len(own), UNITS), np.float32)
                for at in range(0, steps, WINDOW):
                    of = slice(at, at + WINDOW)
                    if not weight[of].any():
                        h = self.forward(h, ids[of])[0][-1]
                        continue
                    g, read, h = self.gradients(h, ids[of], goals[of], None, weight[of])
                    n += 1
                    size = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
                    root = float(np.sqrt(1 / (1 - 0.99**n)))
                    lr, least = rate * min(1.0, n / WARM) / (1 - 0.9**n) / root, 1e-7 / root
                    for k, x in g.items():
                        if size > 1:
                            x *= x.dtype.type(1 / size)
                        # moments of inputs move when they are read
                        mean, power = (m[k][read], v[k][read]) if k == "input" else (m[k], v[k])
                        mean *= 0.9
                        mean += x
                        x *= x
                        power *= 0.99
                        power += x
                        np.sqrt(power, out=x)
                        x += least
                        np.divide(mean, x, out=x)
                        x *= lr
                        if k == "input":
                            m[k][read], v[k][read] = mean, power
                            self.p[k][read] -= x
                        else:
                            self.p[k] -= x
        return learnt

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of each document's probability, without the tokens' shares of shared numbers."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for side in range(0, len(order), SIDE):
            own = order[side : side + SIDE]
            lengths = np.array([len(docs[i]) for i in own])
            first = np.cumsum(lengths) - lengths
            goals = np.concatenate([docs[i] for i in own])
            given = np.empty_like(goals)
            given[1:] = goals[:-1]
            given[first[lengths > 0]] = self.start
            h, found = np.zeros((len(own), UNITS), np.float32), np.zeros(len(own))
            for at in range(0, int(lengths[0]), STEPS):
                live = int(np.searchsorted(-lengths, -at))
                times = np.arange(at, min(at + STEPS, int(lengths[0])))[:, None]
                real = times < lengths[:live]
                places = first[:live] + np.minimum(times, lengths[:live] - 1)
                states = self.forward(h[:live], given[places])[0]
                h = states[-1]
                if real.all():
                    found[:live] += self.log_probs(states[1:].reshape(-1, UNITS), goals[places].ravel()).reshape(real.shape).sum(0)
                else:
                    logs = np.zeros(real.shape)
                    logs[real] = self.log_probs(states[1:][real], goals[places[real]])
                    found[:live] += logs.sum(0)
            out[own] = found
        return out


def passages(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(round, numbers, how many are read only) of a document's passages; all are learnt."""
    for k in range(0, len(numbers), PASSAGE):
        own = np.ascontiguousarray(numbers[k : k + PASSAGE], np.uint32)
        read = min(k, WINDOW)
        yield zlib.crc32(own.tobytes(), k) % ROUNDS, np.ascontiguousarray(numbers[k - read : k + PASSAGE], np.uint32), read


@dataclass
class Model:
    """The counted tokens that all tasks know, and the network."""

    table: pa.Array  # the tokens by their places, the most frequent one first
    log_counts: np.ndarray  # log10(c + 1) by place
    goals: np.ndarray  # by place: the network's number of the token
    bucket_logs: np.ndarray  # log10 of each shared number's total
    network: Network
    tokens: int
    types: int

    def numbers(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The network's numbers of tokens, and their places (-1: not among those known here)."""
        places = pc.fill_null(pc.index_in(tokens, value_set=self.table), -1).to_numpy().astype(np.int64)
        goals = self.goals[places] if len(self.goals) else np.zeros(len(tokens), np.int64)
        other = np.flatnonzero(places < 0)
        shared, tails = self.network.shared, self.network.tails
        goals[other] = [shared + bucket(t, tails) for t in tokens.take(pa.array(other)).to_pylist()]
        return goals, places


def fit(docs: DataFrame, counted: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> Model:
    """The model of the counts ``counted`` with a network trained on the rows of ``docs`` where ``learn`` holds."""
    # the least count that MAPPED tokens or fewer reach, from a histogram of powers of 2^(1/16)
    power = F.floor(F.log2("c") * 16)
    left, floor = MAPPED, None
    powers = counted.groupBy(power.alias("power")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("c")).collect()
    for r in sorted(powers, reverse=True):
        if r.n > left:
            break
        left, floor = left - r.n, r.least
    known = counted.where(F.lit(False) if floor is None else (F.col("c") >= floor) & (F.octet_length("token") <= LONGEST)).collect()
    known.sort(key=lambda r: (-r.c, bytes(r.token)))
    table = [bytes(r.token) for r in known]
    heads, tokens, types = min(HEAD, len(known)), sum(r.c for r in powers), sum(r.n for r in powers)
    tails = tails_of(types)
    # the counts of the shared numbers, each token's plus one, and one unknown; head tokens are taken out again
    end = F.pmod(F.crc32(F.substring("token", -3, 3)), F.lit(tails))
    place = F.pmod(F.shiftright(F.crc32("token"), 8), F.lit(PER_CLASS))
    totals = np.ones(tails * PER_CLASS)
    for r in counted.groupBy((end * PER_CLASS + place).alias("k")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        totals[r.k] += r.n
    for r in known[:heads]:
        totals[bucket(bytes(r.token), tails)] -= r.c + 1
    masses = np.concatenate([np.array([r.c for r in known[:heads]], float), np.zeros(-heads % PER_CLASS), totals])
    network = Network(heads, tails, masses)
    goals = np.array([i if i < heads else network.shared + bucket(t, tails) for i, t in enumerate(table)], np.int64)
    model = Model(pa.array(table, pa.binary()), np.log10(np.array([r.c for r in known], float) + 1), goals, np.log10(totals), network, tokens, types)
    _train(docs.where(learn), model, text)
    return model


def _train(docs: DataFrame, model: Model, text: str) -> None:
    """Rounds of training in the tasks, the parameters averaged after each."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    narrow = np.dtype(np.uint16 if model.network.start < 1 << 16 else np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value
        for batch in gathered(batches):
            tokens, lengths = split(batch.column(0))
            found = [x for own in np.split(mine.numbers(tokens)[0], np.cumsum(lengths)[:-1]) for x in passages(own)]
            columns = [pa.array([r for r, _, _ in found], pa.int32()), pa.array([x.astype(narrow).tobytes() for _, x, _ in found], pa.binary()), pa.array([n for _, _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for _, x, _ in found], pa.int64())], names=["round", "numbers", "read", "n"])

    learnt = common.materialise(docs.select(F.col(text).alias("__text")).mapInArrow(cut, "round int, numbers binary, read int, n long"), "passages")
    sizes = {r["round"]: r.n for r in learnt.groupBy("round").agg(F.sum("n").alias("n")).collect()}

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for tokens, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.float32).astype(np.float64) * tokens
                total, n = own if total is None else total + own, n + tokens
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["tokens", "params"])

    for r in range(ROUNDS):
        if not sizes.get(r):
            continue
        tasks = min(MOST_TASKS, -(-int(sizes[r]) // TASK_TOKENS))
        sent, rate = spark.sparkContext.broadcast(model.network), RATE * (1 - r / (2 * ROUNDS))

        def train(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            keep_memory()
            own = Network.__new__(Network)
            own.__dict__ |= sent.value.__dict__
            own.p = {k: v.copy() for k, v in sent.value.p.items()}
            n = own.learn(((np.frombuffer(raw, narrow), read) for b in batches for raw, read in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), rate)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.packed()], pa.binary())], names=["tokens", "params"])

        trained = learnt.where(F.col("round") == r).select("numbers", "read").repartition(tasks).mapInArrow(train, "tokens long, params binary")
        average = lambda df, n: df.repartition(n).mapInArrow(mean, "tokens long, params binary")
        found = average(average(trained, 32) if tasks > 32 else trained, 1).collect()
        if found:
            model.network.unpack(bytes(found[0].params))


def score(docs: DataFrame, model: Model, counted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    names = ["row", key, "n_tokens", "known", "logs", "model", "rare"]

    def read(mine: Model, batch: pa.RecordBatch) -> tuple[list, list[np.ndarray], np.ndarray]:
        """The columns but the first and the network's share of ``model``, the texts' numbers, and the shared numbers' share of ``model``."""
        n, net = batch.num_rows, mine.network
        tokens, lengths = split(batch.column(1))
        goals, places = mine.numbers(tokens)
        rows, known = np.repeat(np.arange(n), lengths), places >= 0
        totals = lambda values, of: np.bincount(rows[of], values, n).astype(float)
        logs, tail = np.zeros(len(places)), goals >= net.shared
        logs[known] = mine.log_counts[places[known]]
        # the shares of the shared numbers; a rare token's count is added by the join
        shares = totals(logs[tail] - mine.bucket_logs[goals[tail] - net.shared], tail)
        others = pa.table([pa.array(rows[~known]), tokens.filter(pa.array(~known))], ["row", "token"])
        others = others.group_by(["row", "token"], use_threads=False).aggregate([([], "count_all")]).sort_by("row").combine_chunks()
        ends = np.searchsorted(others["row"].to_numpy(), np.arange(n + 1))
        values = [pa.concat_arrays(others[c].chunks).cast(kind) if len(others) else pa.array([], kind) for c, kind in (("token", pa.binary()), ("count_all", pa.int32()))]
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, ["token", "n"]))
        columns = [batch.column(0), pa.array(lengths), pa.array(np.bincount(rows[known], minlength=n)), pa.array(totals(logs[known], known)), rare]
        return columns, np.split(goals.astype(np.int32), np.cumsum(lengths)[:-1]), shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        mine, at = held.value, TaskContext.get().partitionId() << 33
        ready: list[tuple[list, list[np.ndarray], np.ndarray]] = []

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal at
            # long documents of all of them go side by side
            found = mine.network.score([x for _, numbers, _ in ready for x in numbers]) / np.log(10)
            for (*columns, rare), numbers, shares in ready:
                n = len(numbers)
                own, found = found[:n] + shares, found[n:]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *columns, pa.array(own), rare], names=names)
                at += n
            ready.clear()

        size = 0
        for batch in gathered(batches):
            ready.append(read(mine, batch))
            size += sum(map(len, ready[-1][1]))
            if size > SCORED:
                yield from scored()
                size = 0
        if ready:
            yield from scored()

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(key, F.col(text).alias("__text")).mapInArrow(run, f"row long, `{key}` {kind}, n_tokens long, known long, logs double, model double, rare array<struct<token:binary,n:int>>")
    rows = common.materialise(made, "scored")
    each = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    joined = each.join(counted, "token")
    late = joined.groupBy("row").agg(F.sum("n").alias("late_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("late_logs"))
    full = rows.drop("rare").join(late, "row", "left")
    logs = F.coalesce("late_logs", F.lit(0.0))
    return full.select(
        key, "n_tokens", (F.col("known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
