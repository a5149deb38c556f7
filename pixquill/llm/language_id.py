"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes.  One network reads a segment
forwards, one backwards, and their two states label every byte with a language;
a document's probabilities are the mean of those of all its bytes.  Segments of
all lengths of text are worked on together, one matrix row per state and one
column per segment.

The network is trained in numpy by backpropagation through time, in one task, on
a bounded sample of labelled documents, and written to the shared folder as one
row.  Gates use the piecewise linear sigmoid clip(x / 4 + 1/2, 0, 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import broadcast_if_small, pick, slices

SEGMENT = 64
STATES = 8
#: Labelled documents per language that the network is trained on, at most, and bytes taken of each.
TRAINING_DOCUMENTS = 400
TRAINING_BYTES = 512
EPOCHS = 6
BATCH = 256
RATE = 0.02
SEED = 12
#: Segments that one step inside a task labels at once.
COLUMNS = 2048
UNKNOWN = "und"
#: One document in so many is held out of the training.
HOLD_OUT = 3


# --- network --------------------------------------------------------------------


class Network:
    """``x``: what a byte adds to the gates (update, reset, candidate), ``u``: what the state adds,
    ``w`` and ``b``: states to languages; one of ``x`` and ``u`` for each direction."""

    NAMES = ("x0", "x1", "u0", "u1", "w", "b")

    def __init__(self, langs: list[str], values: dict[str, np.ndarray]):
        self.langs = langs
        self.values = values

    @classmethod
    def fresh(cls, langs: list[str], states: int = STATES, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, size: rng.normal(0, size, shape).astype(np.float32)
        return cls(langs, {
            "x0": draw(256, 3 * states, size=0.5), "x1": draw(256, 3 * states, size=0.5),
            "u0": draw(3 * states, states, size=states**-0.5), "u1": draw(3 * states, states, size=states**-0.5),
            "w": draw(len(langs), 2 * states, size=0.1), "b": np.zeros((len(langs), 1), np.float32),
        })

    def read(self, side: int, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of ``codes`` (byte of the segment, segment), and what the gradients need."""
        x, u = np.ascontiguousarray(self.values[f"x{side}"].T), self.values[f"u{side}"]
        n, (steps, width) = u.shape[1], codes.shape
        h, out, trace = np.zeros((n, width), np.float32), np.empty((steps, n, width), np.float32), []
        gates, back = np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            np.take(x, codes[t], axis=1, out=gates, mode="clip")
            np.matmul(u, h, out=back)
            open_, c = gates[: 2 * n], gates[2 * n :]
            open_ += back[: 2 * n]
            open_ *= 0.25
            open_ += 0.5
            np.clip(open_, 0, 1, out=open_)
            if keep:
                trace.append((t, h, open_.copy(), back[2 * n :].copy()))
            back[2 * n :] *= open_[n:]
            c += back[2 * n :]
            np.tanh(c, out=c)
            if keep:
                trace[-1] += (c.copy(),)
            after = out[t]
            np.subtract(h, c, out=after)
            after *= open_[:n]
            after += c
            h = after
        return out, trace

    def label(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, list]:
        """Probabilities (byte, language, segment), the states of both directions, and their traces if asked to keep them."""
        both = [self.read(side, codes, keep) for side in (0, 1)]
        n = self.values["u0"].shape[1]
        p = np.matmul(self.values["w"][:, :n], both[0][0])
        p += np.matmul(self.values["w"][:, n:], both[1][0])
        p += self.values["b"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, [b[0] for b in both], [b[1] for b in both]

    def gradients(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean loss per byte and its gradients; ``target`` per segment, ``weight`` per byte and segment."""
        p, states, traces = self.label(codes, True)
        n, width = self.values["u0"].shape[1], codes.shape[1]
        at = np.arange(width)
        total = weight.sum()
        loss = float(-(np.log(np.maximum(p[:, target, at], 1e-9)) * weight).sum() / total)
        p[:, target, at] -= 1
        p *= (weight / total)[:, None, :]
        flat = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
        out = {"w": flat(p) @ np.concatenate([flat(s) for s in states]).T, "b": p.sum(axis=(0, 2))[:, None]}
        hot = np.zeros((codes.size, 256), np.float32)
        hot[np.arange(codes.size), codes.ravel()] = 1
        for side in (0, 1):
            u = self.values[f"u{side}"]
            above = np.matmul(self.values["w"][:, side * n : (side + 1) * n].T, p)
            into, du, dh = np.empty((len(codes), 3 * n, width), np.float32), np.zeros_like(u), np.zeros((n, width), np.float32)
            for t, h, open_, back, c in reversed(traces[side]):
                dh = dh + above[t]
                z, r = open_[:n], open_[n:]
                dc = dh * (1 - z) * (1 - c * c)
                d = into[t]
                d[:n] = dh * (h - c)
                d[n : 2 * n] = dc * back
                d[: 2 * n] *= 0.25 * ((open_ > 0) & (open_ < 1))
                d[2 * n :] = dc
                to_state = d.copy()
                to_state[2 * n :] *= r
                du += to_state @ h.T
                dh = dh * z + u.T @ to_state
            out[f"u{side}"], out[f"x{side}"] = du, hot.T @ flat(into).T
        return loss, out


def segments(text: bytes, size: int = SEGMENT) -> np.ndarray:
    """The bytes in rows of ``size``, the last filled with blanks."""
    codes = np.full(-(-len(text) // size) * size, 32, np.uint8)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return codes.reshape(-1, size)


def train(codes: np.ndarray, target: np.ndarray, weight: np.ndarray, langs: list[str], epochs: int = EPOCHS,
          states: int = STATES, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network fitted to segments (rows of ``codes``) of languages ``target``; Adam, with a falling rate."""
    net, rng = Network.fresh(langs, states, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.values.items()}
    second = {k: np.zeros_like(v) for k, v in net.values.items()}
    steps = max(1, epochs * -(-len(codes) // batch))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, grads = net.gradients(codes[own].T.astype(np.intp), target[own], weight[own].T)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            done += 1
            pace = rate * (1 - done / (steps + 1)) * min(1.0, 1.0 / max(norm, 1e-9))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                step = first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
                net.values[k] -= np.float32(pace) * step
    return net


# --- Spark ------------------------------------------------------------------------


def _has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True where the CRC-32 of the id as text is 1 modulo ``HOLD_OUT``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HOLD_OUT)) == 1, F.lit(False))


def _training_segments(rows: DataFrame, size: int) -> DataFrame:
    """``lang, at, segment, length``: of each language at most ``size`` documents, drawn by hash, in pieces from all over their text.

    A share of the documents is drawn here, a little more than needed; the
    training task, which gets them all, cuts to ``size``.
    """
    known = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~F.col("held_out") & F.col("letters"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 32))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(1.3 * size * (1 << 32)) / F.col("n")
    sample = known.join(broadcast_if_small(sizes), "lang").withColumn("drawn", drawn).where(F.col("drawn") < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, list[bytes], int]] = []
            for lang, at, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "drawn", "text"))):
                raw = text.encode("utf-8", "surrogatepass")
                own = segments(raw)
                some = np.sort(np.random.default_rng(at).permutation(len(own))[: TRAINING_BYTES // SEGMENT])
                out += [(lang, at, own[i].tobytes(), min(SEGMENT, len(raw) - SEGMENT * int(i))) for i in some]
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "at", "segment", "length"])

    return sample.select("lang", "drawn", "text").mapInArrow(run, "lang string, at bigint, segment binary, length int")


def fit(rows: DataFrame, size: int = TRAINING_DOCUMENTS, epochs: int = EPOCHS) -> Network | None:
    """The network trained on ``rows`` (doc_id, text, lang, held_out, letters), or None without a document to learn from."""
    order = ["lang", "at", "segment", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in order])
        langs = sorted(set(table.column("lang").to_pylist()), key=lambda v: v.encode("utf-8", "surrogatepass"))
        target = np.array([{v: i for i, v in enumerate(langs)}[v] for v in table.column("lang").to_pylist()])
        at = table.column("at").to_numpy()
        new = np.append(True, (at[1:] != at[:-1]) | (target[1:] != target[:-1]))
        number = np.cumsum(new)
        first = np.minimum.reduceat(number, np.flatnonzero(np.append(True, target[1:] != target[:-1])))
        mine = number - first[np.cumsum(np.append(True, target[1:] != target[:-1])) - 1] < size
        codes = np.frombuffer(b"".join(table.column("segment").to_pylist()), np.uint8).reshape(-1, SEGMENT)[mine]
        weight = (np.arange(SEGMENT) < table.column("length").to_numpy()[mine, None]).astype(np.float32)
        net = train(codes, target[mine], weight, langs, epochs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs], pa.list_(pa.string())), pa.array([list(net.values)], pa.list_(pa.string())),
                pa.array([[list(v.shape) for v in net.values.values()]], pa.list_(pa.list_(pa.int64()))),
                pa.array([[v.tobytes() for v in net.values.values()]], pa.list_(pa.binary())),
            ],
            ["langs", "names", "shapes", "parts"],
        )

    # a bounded number of segments: one task can hold them, and if it is lost, another trains the same
    sample = _training_segments(rows, size).repartition(1)
    schema = "langs array<string>, names array<string>, shapes array<array<bigint>>, parts array<binary>"
    row = materialize(sample.mapInArrow(run, schema), "network").first()
    if row is None:
        return None
    parts = zip(row["names"], row["shapes"], row["parts"])
    return Network(list(row["langs"]), {k: np.frombuffer(bytes(v), np.float32).reshape(s) for k, s, v in parts})


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over the bytes of each text (rows); zeros for an empty text."""
    cut = [segments(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    total = np.zeros((len(texts), len(net.langs)))
    if not len(owner):
        return total
    codes = np.concatenate(cut)
    length = np.full(len(codes), SEGMENT)
    sizes = np.array([len(t) for t in texts])
    last = np.cumsum([len(c) for c in cut]) - 1
    some = sizes > 0
    length[last[some]] = (sizes[some] - 1) % SEGMENT + 1
    for at in range(0, len(codes), COLUMNS):
        p, _, _ = net.label(codes[at : at + COLUMNS].T.astype(np.intp))
        short = np.flatnonzero(length[at : at + COLUMNS] < SEGMENT)
        for i in short:
            p[length[at + i] :, :, i] = 0
        np.add.at(total, owner[at : at + COLUMNS], p.sum(axis=0, dtype=np.float64).T)
    return total / np.maximum(sizes, 1)[:, None]


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    size: int = TRAINING_DOCUMENTS, epochs: int = EPOCHS,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    The network learns from documents that are not held out and whose language
    is not null; ids, languages and sources are never seen when it predicts.
    ``lang_pred`` is the language of the highest mean probability (``score``; the
    first by UTF-8 of equal ones).  It is ``und`` with score 0 for a null or empty
    text or one without a letter, and for every text if there is nothing to learn
    from.  A row with a null id is neither held out nor learnt from; repeated
    rows come out as often as they go in; an empty table gives no row.
    """
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang).withColumns(
        {"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")}
    )
    rows = rows.withColumns({"held_out": held_out(F.col("doc_id")), "letters": _has_letter("text")})
    net = fit(rows, size, epochs)
    unknown = F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
    if net is None:
        return rows.select("doc_id", "held_out", *unknown)
    asked = rows.select("doc_id", "held_out", F.when(F.col("letters"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            p = np.round(probabilities(net, texts), 9)
            best = p.argmax(axis=1)
            empty = np.array([not t for t in texts], bool)
            names = pa.array([UNKNOWN if e else net.langs[b] for e, b in zip(empty, best)], pa.string())
            score = np.where(empty, 0.0, np.minimum(p[np.arange(len(p)), best], 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), names, pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
