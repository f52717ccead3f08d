"""Secrets by base patterns and a battery of randomness tests.

The battery takes long tokens, infers the encoding of each, and tests the
hypothesis "its symbols are independent and uniform over the alphabet": a
chi-squared test of alphabet uniformity over groups of symbols (letters by case
and by how common they are in prose, digits), a runs test and a
serial-correlation test, combined by Bonferroni.

What such a p-value looks like for ordinary writing is learnt from the corpus:
the words of all documents, joined and cut into pieces of each class of length,
go through the same battery. A token's p-value against ordinary writing is the
share of its class's pieces that look as random as it does. Benjamini-Hochberg
within each class then finds tokens such that at most the set share of those
reported is ordinary writing; of these, tokens stay whose randomness the battery
itself does not reject. The control needs the number of tokens and pieces by class
and p-value bin only, a table of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, read_table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as of [0-9a-f]+, that are long enough
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
#: Words that make up ordinary writing: shorter than a token.
PROSE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9_-]{1,15}+(?![A-Za-z0-9+/_=-])")
#: Least length of each class; pieces of ordinary writing have these lengths.
CLASSES = (16, 20, 32, 48, 96)
BINS = 400

HEXADECIMAL = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = BASE62 + "+/"
BASE64_URL = BASE62 + "-_"
#: Letters from the common to the rare.
TIERS = ("etaoinshr", "dlucmfwyp", "vbgkjqxz")
LONG = 48


@dataclass(frozen=True)
class Battery:
    """``share``: accepted share of ordinary writing among the tokens reported; ``reject``: level at which the battery rules a token out as not random."""

    share: float = 0.05
    reject: float = 0.001


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order, that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def alphabet(token: str) -> str | None:
    """The alphabet of the inferred encoding; None if the token mixes several or is a number."""
    body = token.rstrip("=")
    if re.fullmatch("[0-9]*", body):
        return None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        return HEXADECIMAL
    if re.fullmatch("[A-Z2-7]+", body):
        return BASE32
    if re.fullmatch("[A-Za-z0-9]+", body):
        return BASE62
    if re.fullmatch("[A-Za-z0-9+/]+", body):
        return BASE64
    return BASE64_URL if re.fullmatch("[A-Za-z0-9_-]+", body) else None


def groups(letters: str, long: bool) -> tuple[np.ndarray, np.ndarray]:
    """The group of each byte in an alphabet, and the share of the alphabet that each group holds."""
    if letters is HEXADECIMAL:
        names = {c: k // (2 if long else 4) for k, c in enumerate(letters)}
    else:
        tier = {c: k for k, t in enumerate(TIERS) for c in t}
        upper = lambda c: ("upper", tier[c.lower()] if long or letters is BASE32 else 0)
        names = {c: upper(c) if c.isupper() else ("lower", tier[c]) if c.islower() else ("other", 0) for c in letters}
    order = sorted(set(names.values()))
    table, share = np.zeros(256, np.int64), np.zeros(len(order))
    for c, name in names.items():
        table[ord(c)] = order.index(name)
        share[order.index(name)] += 1 / len(letters)
    return table, share


def places(letters: str) -> np.ndarray:
    """The place of each byte in an alphabet."""
    table = np.zeros(256)
    table[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    return table


TABLES = {x: (places(x), groups(x, False), groups(x, True)) for x in (HEXADECIMAL, BASE32, BASE62, BASE64, BASE64_URL)}


def _upper_normal(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(x) for x in (np.abs(z) / math.sqrt(2)).tolist()])


def _upper_chi(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail of chi-squared, by the Wilson-Hilferty approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * np.array([math.erfc(v) for v in (z / math.sqrt(2)).tolist()])


def p_values(rows: np.ndarray, letters: str) -> np.ndarray:
    """Combined p-values of the battery for tokens of one length and encoding, a row of bytes each."""
    count, n = rows.shape
    place, short, long = TABLES[letters]
    table, share = long if n >= LONG else short
    flat = table[rows] + len(share) * np.arange(count)[:, None]
    seen = np.bincount(flat.ravel(), minlength=count * len(share)).reshape(count, -1)
    p_chi = _upper_chi(((seen - share * n) ** 2 / (share * n)).sum(axis=1), len(share) - 1)
    x = place[rows]
    high = x >= len(letters) / 2
    ones = high.sum(axis=1).astype(float)
    mean = 2 * ones * (n - ones) / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    mixed = (ones > 0) & (ones < n)
    p_runs = np.where(mixed, _upper_normal((1 + (high[:, 1:] != high[:, :-1]).sum(axis=1) - mean) / spread), 2.0 ** (1 - n))
    y = x - x.mean(axis=1)[:, None]
    total = (y * y).sum(axis=1)
    p_serial = np.where(total > 0, _upper_normal(((y[:, 1:] * y[:, :-1]).sum(axis=1) / np.where(total > 0, total, 1) + 1 / n) * math.sqrt(n)), 0.0)
    return np.minimum(1.0, 3 * np.minimum(np.minimum(p_chi, p_runs), p_serial))


def p_value(token: str) -> float:
    """Combined p-value of the battery; 0 for a token in no single encoding."""
    letters = alphabet(token)
    if letters is None:
        return 0.0
    body = token.rstrip("=")
    body = body.lower() if letters is HEXADECIMAL else body
    return float(p_values(np.frombuffer(body.encode(), np.uint8)[None], letters)[0])


def ordinary(prose: list[bytes]) -> dict[tuple[int, int], int]:
    """Pieces of ordinary writing by class and bin. Each text's words are cut into pieces of the lengths of the classes in turn; a rest too short for the next one is left."""
    cuts: list[list[bytes]] = [[] for _ in CLASSES]
    cycle = sum(CLASSES)
    for text in prose:
        for at in range(0, len(text), cycle):
            for k, n in enumerate(CLASSES):
                if at + n <= len(text):
                    cuts[k].append(text[at : at + n])
                at += n
    out: dict[tuple[int, int], int] = {}
    for k, n in enumerate(CLASSES):
        rows = np.frombuffer(b"".join(cuts[k]), np.uint8).reshape(-1, n)
        upper, digit, lower = (rows >= 65) & (rows <= 90), (rows >= 48) & (rows <= 57), (rows >= 97) & (rows <= 122)
        plain = (upper | digit | lower).all(axis=1)
        base32 = (upper | (rows >= 50) & (rows <= 55)).all(axis=1)
        hexadecimal = (digit | (rows >= 97) & (rows <= 102)).all(axis=1) | (digit | (rows >= 65) & (rows <= 70)).all(axis=1)
        kinds = np.select([digit.all(axis=1), hexadecimal, base32, plain], [0, 1, 2, 3], 4)
        for kind, letters in enumerate((HEXADECIMAL, BASE32, BASE62, BASE64_URL), 1):
            own = rows[kinds == kind]
            if len(own):
                own = own | 32 * ((own >= 65) & (own <= 70)) if letters is HEXADECIMAL else own
                bins, n_bins = np.unique(p_bins(p_values(own.astype(np.uint8), letters)), return_counts=True)
                for b, c in zip(bins.tolist(), n_bins.tolist(), strict=True):
                    out[k + 1, b] = out.get((k + 1, b), 0) + c
    return out


def p_bins(p: np.ndarray) -> np.ndarray:
    """Bins in steps of a tenth of a decade; the upper edge of bin k is ``10 ** (-k / 10)``."""
    return np.minimum(BINS, np.floor(-10 * np.log10(np.maximum(p, 1e-300)))).astype(int)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES)


def reported(tokens: dict[int, int], pieces: dict[int, int], battery: Battery) -> int:
    """The last bin whose tokens are reported; -1 if none. ``tokens``, ``pieces``: numbers by bin in one class of length."""
    total, known, last, found, alike = sum(tokens.values()), sum(pieces.values()), -1, 0, 0
    for k in range(BINS + 1):
        if k > -10 * math.log10(battery.reject):
            break
        found, alike = found + tokens.get(k, 0), alike + pieces.get(k, 0)
        if found and (1 + alike) / (1 + known) <= battery.share * found / total:
            last = k
    return last


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, tokens, pieces``, written out.

    A row of each document has its base spans as kind, start and end, and its
    tokens with class, bin, start and end. Rows with ``pieces`` count ordinary
    writing by class and bin.
    """

    def rows(source):
        held, size = [], 0
        for r in source:
            raw = r["text"] or b""
            text = raw.decode()
            base = base_spans(text)
            taken = _union([(a, b) for _, a, b in base])
            tokens = []
            for m in TOKEN.finditer(text):
                k = bisect_left(taken, (m.end(),)) - 1  # the last that starts before the token's end
                if k < 0 or taken[k][1] <= m.start():
                    tokens.append((length_class(m.end() - m.start()), int(p_bins(np.array([p_value(m[0])]))[0]), m.start(), m.end()))
            yield r["doc_id"], [{"kind": k, "start": a, "stop": b} for k, a, b in base], [dict(zip(("size", "bin", "start", "stop"), t, strict=True)) for t in tokens], None
            held.append(b"".join(PROSE.findall(raw)))
            size += len(held[-1])
            if size >= 1 << 20:
                yield None, [], [], _counted(ordinary(held))
                held, size = [], 0
        if held:
            yield None, [], [], _counted(ordinary(held))

    schema = "doc_id long, base array<struct<kind:string,start:long,stop:long>>, tokens array<struct<size:int,bin:int,start:long,stop:long>>, pieces array<struct<size:int,bin:int,n:long>>"
    return materialize(map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema), "secrets")


def _counted(table: dict[tuple[int, int], int]) -> list[dict]:
    return [{"size": k, "bin": b, "n": n} for (k, b), n in sorted(table.items())]


def last_bins(found: DataFrame, battery: Battery) -> dict[int, int]:
    """By class of length the last bin whose tokens are reported."""
    tokens, pieces = found.select(F.explode("tokens").alias("t")), found.select(F.explode("pieces").alias("t"))
    sums = tokens.select("t.size", "t.bin", F.lit(1).cast("long").alias("tokens"), F.lit(0).cast("long").alias("pieces")).union(pieces.select("t.size", "t.bin", F.lit(0).cast("long"), "t.n"))
    table: dict[int, tuple[dict, dict]] = {}
    for r in sums.groupBy("size", "bin").agg(F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces")).collect():  # of fixed size
        own = table.setdefault(r["size"], ({}, {}))
        own[0][r["bin"]], own[1][r["bin"]] = r["tokens"], r["pieces"]
    return {k: reported(t, p, battery) for k, (t, p) in table.items()}


def find_secrets(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """``doc_id``, counts by base kind, ``base_sha256`` and ``spans`` for every row of ``docs``.

    A null or empty text has no spans. Null and repeated ids are kept, repeated
    rows have equal spans. No rows give no rows. Columns other than doc_id and
    text are ignored. Texts and tokens of any length are searched whole. Tokens of
    one class with equal p-value bins are reported together or not at all.
    Without ordinary writing of a class's length nothing of that class is reported.
    """
    found = scan(docs)
    last = last_bins(found, battery)

    def random(t: Column) -> Column:
        out = F.lit(False)
        for k, b in sorted(last.items()):
            out = out | ((t["size"] == k) & (t["bin"] <= b))
        return out

    new = F.transform(F.filter("tokens", random), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["stop"].alias("stop")))
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.where("pieces is null").select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", new)).alias("spans"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _listed(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """Counts and digest by the patterns as the contract words them, for tests."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return *(sum(k == j for _, k, _ in out) for j in range(3)), hashlib.sha256(listed.encode()).hexdigest()
