"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``window`` bytes that cover all of it.  In each window one gated recurrent
network reads forwards and one backwards; their two states at a position give that position's language probabilities,
and the document's are the mean over all its positions.  The network is trained in numpy by backpropagation through
time on windows of a bounded sample.  Windows of many texts are computed together, so numpy works on large matrices;
a worker's memory depends on the block of windows and not on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language`` rows of a language are expected in the sample (at most twice as many on average), and of each ``per_text`` windows at most."""

    hidden: int = 12
    embedding: int = 12
    window: int = 64
    per_language: int = 150
    per_text: int = 64
    steps: int = 250
    batch: int = 96
    rate: float = 0.01
    clip: float = 1.0
    seed: int = 11
    #: Windows computed at once when labelling.
    block: int = 1024


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: dict[str, np.ndarray]
    window: int


def windows_of(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``window`` bytes plus one, 256 after the end, and the number of bytes in each row."""
    n = -(-len(data) // window)
    rows = np.full(n * window, 256, np.int16)
    rows[:len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, window)
    if n:
        sizes[-1] = len(data) - (n - 1) * window
    return rows.reshape(n, window), sizes


def initial(languages: int, s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    weights = {"embed": rng.normal(0, 0.5, (257, s.embedding))}
    for side in "fb":
        weights[f"w{side}"] = rng.normal(0, s.embedding ** -0.5, (s.embedding, 3 * s.hidden))
        weights[f"u{side}"] = rng.normal(0, s.hidden ** -0.5, (s.hidden, 3 * s.hidden))
        weights[f"c{side}"] = np.zeros(3 * s.hidden)
    weights["out"] = rng.normal(0, (2 * s.hidden) ** -0.5, (2 * s.hidden, languages))
    weights["bias"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def scan(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent network; ``x`` is (time, rows, 3 * hidden), the inputs of update, reset and candidate."""
    time, rows, width = x.shape
    h = width // 3
    state, states = np.zeros((rows, h), np.float32), np.empty((time, rows, h), np.float32)
    gates_u, new_u = np.ascontiguousarray(u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])
    for t in range(time):
        gates = _sigmoid(x[t, :, :2 * h] + state @ gates_u)
        update, reset = gates[:, :h], gates[:, h:]
        gated = reset * state
        new = np.tanh(x[t, :, 2 * h:] + gated @ new_u)
        if keep is not None:
            keep.append((state, update, reset, gated, new))
        state = state + update * (new - state)
        states[t] = state
    return states


def scan_gradient(d_states: np.ndarray, keep: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of ``u``, backwards through time."""
    time, rows, h = d_states.shape
    dx, du, carry = np.empty((time, rows, 3 * h), np.float32), np.zeros_like(u), np.zeros((rows, h), np.float32)
    for t in reversed(range(time)):
        state, update, reset, gated, new = keep[t]
        d = d_states[t] + carry
        d_new = d * update * (1 - new * new)
        d_gated = d_new @ u[:, 2 * h:].T
        d_update = d * (new - state) * update * (1 - update)
        d_reset = d_gated * state * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], axis=1)
        dx[t, :, :2 * h], dx[t, :, 2 * h:] = d_gates, d_new
        du[:, :2 * h] += state.T @ d_gates
        du[:, 2 * h:] += gated.T @ d_new
        carry = d * (1 - update) + d_gated * reset + d_gates @ u[:, :2 * h].T
    return dx, du


def add_logits(logits: np.ndarray, codes: np.ndarray, inputs: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
    """Add one direction's share to ``logits`` (languages, time, rows), like :func:`scan` but in place and step by step.

    ``inputs`` has the inputs of the three gates for each byte.  The sigmoid is taken as 1 / (1 + exp(-x)) and the hyperbolic
    tangent as 2 / (1 + exp(-2 x)) - 1, whose factors are put into the weights beforehand.
    """
    h, rows = len(u), codes.shape[1]
    factors = np.concatenate([np.full(2 * h, -1), np.full(h, -2)]).astype(np.float32)
    inputs, u = inputs * factors, u * factors
    gates_in, new_in = np.ascontiguousarray(inputs[:, :2 * h]), np.ascontiguousarray(inputs[:, 2 * h:])
    gates_u, new_u = np.ascontiguousarray(u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])
    state, gates, new = np.zeros((rows, h), np.float32), np.empty((rows, 2 * h), np.float32), np.empty((rows, h), np.float32)
    gates_x, new_x, gated, step, out = np.empty_like(gates), np.empty_like(new), np.empty((rows, h), np.float32), np.empty((out.shape[1], rows), np.float32), np.ascontiguousarray(out.T)
    with np.errstate(over="ignore"):  # exp(x) may be infinite, then its inverse is zero
        for t in range(len(codes)):
            np.matmul(state, gates_u, out=gates)
            gates += np.take(gates_in, codes[t], axis=0, out=gates_x, mode="clip")
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)
            np.multiply(gates[:, h:], state, out=gated)
            np.matmul(gated, new_u, out=new)
            new += np.take(new_in, codes[t], axis=0, out=new_x, mode="clip")
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            new -= state
            new *= gates[:, :h]
            state += new
            np.matmul(out, state.T, out=step)
            logits[:, t] += step


def position_scores(rows: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Language probabilities at every position, (languages, time, rows)."""
    codes, h = np.ascontiguousarray(rows.T), len(w["uf"])
    logits = np.empty((len(w["bias"]), *codes.shape), np.float32)
    logits[:] = w["bias"][:, None, None]
    add_logits(logits, codes, w["embed"] @ w["wf"] + w["cf"], w["uf"], w["out"][:h])
    add_logits(logits[:, ::-1], codes[::-1], w["embed"] @ w["wb"] + w["cb"], w["ub"], w["out"][h:])
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def loss_gradient(rows: np.ndarray, target: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions within the text, and its gradient."""
    codes, h = rows.T, len(w["uf"])
    inside = codes < 256
    embedded = w["embed"][codes]
    keep_f, keep_b = [], []
    forward = scan(embedded @ w["wf"] + w["cf"], w["uf"], keep_f)
    backward = scan((embedded @ w["wb"] + w["cb"])[::-1], w["ub"], keep_b)[::-1]
    both = np.concatenate([forward, backward], axis=2)
    logits = both @ w["out"] + w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    chance = np.exp(logits)
    chance /= chance.sum(axis=2, keepdims=True)
    n = max(1, inside.sum())
    picked = np.take_along_axis(chance, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(picked + 1e-9) * inside).sum() / n)
    d = chance
    np.put_along_axis(d, np.broadcast_to(target[None, :, None], (*codes.shape, 1)), (picked - 1)[..., None], 2)
    d *= (inside / np.float32(n))[..., None].astype(np.float32)
    flat = d.reshape(-1, d.shape[2])
    g = {"out": both.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(axis=0)}
    d_both = d @ w["out"].T
    dxf, g["uf"] = scan_gradient(d_both[..., :h], keep_f, w["uf"])
    dxb, g["ub"] = scan_gradient(d_both[::-1, :, h:], keep_b, w["ub"])
    dxb = dxb[::-1]
    e = embedded.reshape(-1, embedded.shape[2])
    d_embedded = np.zeros_like(e)
    for side, dx in (("f", dxf), ("b", dxb)):
        dx = np.ascontiguousarray(dx).reshape(len(e), -1)
        g[f"w{side}"], g[f"c{side}"] = e.T @ dx, dx.sum(axis=0)
        d_embedded += dx @ w[f"w{side}"].T
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], codes.reshape(-1), d_embedded)
    return loss, g


def fit(texts: list[str | bytes], langs: list[str], s: Settings = Settings()) -> Model:
    """Train on windows of texts, or of bytes, drawn at random, each language as often as any other."""
    names = tuple(sorted(set(langs)))
    w = initial(max(1, len(names)), s)
    if len(names) < 2:
        return Model(names, w, s.window)
    pools = []
    for name in names:
        pool = [windows_of(t if isinstance(t, bytes) else t.encode("utf-8", "replace"), s.window)[0] for t, lang in zip(texts, langs, strict=True) if lang == name]
        pools.append(np.concatenate(pool))
    usable = [i for i, p in enumerate(pools) if len(p)]
    if not usable:
        return Model(names, w, s.window)
    rng = np.random.default_rng(s.seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    for t in range(1, s.steps + 1):
        target = rng.choice(usable, s.batch)
        rows = np.stack([pools[i][rng.integers(len(pools[i]))] for i in target])
        _, g = loss_gradient(rows, target, w)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = s.rate * min(1.0, 2 * (1 - t / (s.steps + 1)))
        for k in w:
            x = g[k] * min(1.0, s.clip / (norm + 1e-9))
            m[k], v2[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v2[k] + 0.01 * x * x
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return Model(names, w, s.window)


def pooled(texts: list[str | None], model: Model, block: int) -> np.ndarray:
    """Mean language probabilities over the positions of each text; zero for a text without bytes."""
    total = np.zeros((len(texts), len(model.names)))
    counts = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        rows, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        owner = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        held.clear()
        for lo in range(0, len(rows), block):
            part = slice(lo, lo + block)
            scores = position_scores(rows[part], model.weights)
            scores *= rows[part].T < 256
            np.add.at(total, owner[part], scores.sum(axis=1).T)
        np.add.at(counts, owner, sizes)

    waiting, stride = 0, block * model.window
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        for start in range(0, len(data), stride):  # a very long text block by block
            rows, sizes = windows_of(data[start:start + stride], model.window)
            held.append((i, rows, sizes))
            waiting += len(rows)
            if waiting >= block:
                flush()
                waiting = 0
    if held:
        flush()
    return total / np.maximum(counts, 1)[:, None]


def some_windows(text: Column, key: Column, window: int, most: int, seed: int) -> Column:
    """Bytes of up to ``most`` windows of a whole text, one after the other: all of them, or as many drawn by ``key``."""

    @F.pandas_udf("binary")
    def drawn(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, keys, strict=True):
            data = t.encode("utf-8", "replace")
            n = len(data) // window  # whole windows, and the rest of a text that has none
            if n > most:
                some = np.sort(np.random.default_rng([seed, int(k) & (1 << 63) - 1]).choice(n, most, replace=False))
                data = b"".join(data[i * window:(i + 1) * window] for i in some.tolist())
            out.append(data)
        return pd.Series(out)

    return drawn(text, key)


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          settings: Settings = Settings()) -> Model:
    """Learn every language that occurs, from rows where ``usable`` holds and text and language are not NULL.

    The sample is drawn by a hash of the id, about as many rows of each language, and of a long text as many windows from all over
    it.  The driver gets windows only: ``2 * per_language * per_text`` of a language at most.
    """
    ok = docs.filter((F.lit(True) if usable is None else usable) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = ok.select(F.xxhash64(F.col(id_col)).alias("_key"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    counts = written(rows.groupBy("_lang").count())  # a row per class of the model
    languages = counts.count()
    if not languages:
        return fit([], [], settings)
    share = settings.per_language / F.col("count")
    drawn = rows.join(counts, "_lang").filter(F.pmod("_key", F.lit(1 << 40)) / float(1 << 40) <= share)
    sample = drawn.limit(2 * settings.per_language * languages).select(some_windows(F.col("_text"), F.col("_key"), settings.window, settings.per_text, settings.seed), "_lang").collect()
    return fit([bytes(r[0]) for r in sample], [r[1] for r in sample], settings)


def identify(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            has = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model.names and any(has):
                chance = pooled([t if ok else None for t, ok in zip(texts, has, strict=True)], model, settings.block)
                best = chance.argmax(axis=1)
                names = np.where(has, np.array(model.names, object)[best], UNKNOWN)
                scores = np.where(has, np.clip(chance[np.arange(len(best)), best], 0, 1), 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return found(text)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, in one pass and without a shuffle.

    NULL and texts without a letter are ``und`` with score 0, and so is every text if no language was learned; repeated rows
    are judged each for itself, other columns are ignored, an empty table gives an empty result.
    """
    return docs.select(F.col(id_col).alias("doc_id"), identify(F.col(text_col), model, settings).alias("r")).select("doc_id", "r.*")
