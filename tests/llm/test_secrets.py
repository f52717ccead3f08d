"""The randomness battery: its p-values, its control of ordinary writing, and spans that it adds."""

import numpy as np

from siftline.llm import secrets

WORDS = "the of and report system configuration user server update network version release access session database connection request message public private internal document customer business information government management development international organization responsibility characteristic environment implementation".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def key(rng, letters, n):
    return "".join(rng.choice(list(letters), n))


def ordinary_tokens(rng, n):
    """Long names as they stand in ordinary writing."""
    out = []
    for _ in range(n):
        words = [str(w) for w in rng.choice(WORDS, 4)]
        out.append([lambda w: "".join(x.title() for x in w), "-".join, "_".join, "/".join, "".join, lambda w: "_".join(w).upper()][rng.integers(6)](words) + ["", "2", "-2024", "v3"][rng.integers(4)])
    return [x for x in out if len(x) >= 16]


def test_p_values_of_random_tokens():
    rng = np.random.default_rng(5)
    for letters in (secrets.HEXADECIMAL, secrets.BASE32, secrets.BASE62, secrets.BASE64):
        for n in (16, 24, 40, 100):
            p = np.array([secrets.p_value(key(rng, letters, n)) for _ in range(400)])
            assert (p < 0.05).mean() < 0.12 and (p < 0.001).mean() < 0.02, (letters, n)
    p = np.array([secrets.p_value(x) for x in ordinary_tokens(rng, 500)])
    assert (p < 0.001).mean() > 0.95
    assert secrets.p_value("1234567890123456") == 0.0 and secrets.alphabet("a+b_c/d-e") is None


def test_bulk_equals_single():
    rng = np.random.default_rng(6)
    text = b"".join(secrets.PROSE.findall(prose(rng, 400).encode()))
    want: dict = {}
    at = 0
    while at < len(text):
        for k, n in enumerate(secrets.CLASSES):
            if at + n <= len(text):
                bin_ = int(secrets.p_bins(np.array([secrets.p_value(text[at : at + n].decode())]))[0])
                want[k + 1, bin_] = want.get((k + 1, bin_), 0) + 1
            at += n
    assert secrets.ordinary([text]) == want


def test_reported_bins():
    battery = secrets.Battery(0.05, 0.001)
    # 10 tokens look random, 90 like ordinary writing; one of 10,000 pieces looks random.
    assert secrets.reported({3: 10, 80: 90}, {3: 1, 80: 9_999}, battery) >= 3
    assert secrets.reported({3: 10, 80: 90}, {3: 600, 80: 9_400}, battery) == -1
    assert secrets.reported({80: 90}, {80: 10}, battery) == -1 and secrets.reported({3: 5}, {}, battery) == -1


def test_planted_keys_are_found(spark):
    rng = np.random.default_rng(7)
    rows, planted, plain = [], {}, 0
    for k in range(600):
        text = prose(rng, 120)
        if k % 6 == 0:
            token = key(rng, [secrets.BASE62, secrets.BASE64, secrets.BASE32][k // 6 % 3], int(rng.integers(20, 60)))
            text += " " + token + " " + prose(rng, 5)
            planted[k] = f"random:{text.index(token)}:{text.index(token) + len(token)}"
        else:
            token = ordinary_tokens(rng, 1)
            text += " " + " ".join(token) + " end"
            plain += len(token)
        rows.append((k, text))
    rows += [(1000, "word " * 10 + key(rng, secrets.BASE62, 200_000)), (1001, None)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    found = {k for k, want in planted.items() if want in got[k].split(",")}
    wrong = [k for k in range(600) if k not in planted and "random" in got[k]]
    assert len(found) >= 0.9 * len(planted) and plain > 400
    assert len(wrong) <= 0.1 * (len(found) + len(wrong)), len(wrong)
    assert got[1001] == "" and got[1000].startswith("random:50:")
