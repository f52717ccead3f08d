"""Composite text density against a plain recomputation on random trees, and hostile pages."""

import math
import random
import re
import time

from siftline.llm import html_text
from siftline.llm.html_text import main_text


def random_tree(rng, depth=0):
    """A block as (tag, parts): parts are texts, links and blocks."""
    parts = []
    for _ in range(rng.randint(1, 5 if depth < 3 else 2)):
        kind = rng.random()
        words = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice([1, 3, 30])))
        if kind < 0.35 and depth < 4:
            parts.append(random_tree(rng, depth + 1))
        elif kind < 0.5:
            parts.append(("a", [words]))
        else:
            parts.append(words)
    return (rng.choice(["div", "section"]), parts)


def as_html(node):
    tag, parts = node
    return f"<{tag}>" + "".join(p if isinstance(p, str) else as_html(p) for p in parts) + f"</{tag}>"


def figures(node, linked=False):
    """Characters, tags, link characters and link tags of a block and all below it."""
    tag, parts = node
    out = [0, 1, 0, int(tag == "a")]
    for p in parts:
        if isinstance(p, str):
            out[0] += len(p)
            out[2] += len(p) * (linked or tag == "a")
        else:
            out = [x + y for x, y in zip(out, figures(p, linked or tag == "a"), strict=True)]
    return out


def density(node, root):
    c, t, lc, lt = figures(node)
    rc, _, rl, _ = figures(root)
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + rl / rc * c + math.e)
    return max(0.0, c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0))


def blocks(node):
    yield node
    for p in node[1]:
        if not isinstance(p, str) and p[0] != "a":
            yield from blocks(p)


def lines_of(node, keep):
    """Lines of the blocks kept, in page order: text runs cut where a block begins or ends."""
    out, run = [], []

    def cut():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    def walk(n, linked_in):
        for p in n[1]:
            if isinstance(p, str):
                if id(linked_in) in keep:
                    run.append(p)
            elif p[0] == "a":
                walk(p, linked_in)
            else:
                cut()
                walk(p, p)
                cut()

    walk(node, node)
    cut()
    return out


def brute(root):
    """The core is the block with the greatest sum of its child blocks' densities; side branches of its path count from the path's least density on."""
    everything = list(blocks(root))
    children = {id(n): [p for p in n[1] if not isinstance(p, str) and p[0] != "a"] for n in everything}
    d = {id(n): density(n, root) for n in everything}
    sums = {id(n): sum(d[id(c)] for c in children[id(n)]) for n in everything}
    best = max(sums.values())
    parent = {id(c): n for n in everything for c in children[id(n)]}
    out = []
    for core in (n for n in everything if sums[id(n)] == best):
        path = [core]
        while id(path[-1]) in parent:
            path.append(parent[id(path[-1])])
        least = min(d[id(n)] for n in path)
        keep = {id(n) for n in blocks(core)} | {id(n) for n in path}
        for n in path[1:]:
            for c in children[id(n)]:
                if c not in path and d[id(c)] >= least:
                    keep |= {id(x) for x in blocks(c)}
        out.append("\n".join(lines_of(root, keep)))
    return out


def test_density_on_random_trees():
    rng = random.Random(11)
    for _ in range(300):
        root = ("body", random_tree(rng)[1])
        assert main_text(as_html(root).encode()) in brute(root), as_html(root)


def test_line_breaks_are_white_space():
    long = "Sentence that is long enough to be the text of the page. " * 3
    assert main_text(f"<body><p>{long}one<br>two<br/>three</p><p>{long}</p></body>".encode()) == f"{long}one two three\n{long.strip()}"


def test_hostile_pages_take_time_in_proportion():
    shapes = {
        "open inline, items": lambda n: "<i>" * n + "<li>x</li>" * n,
        "open center, paragraphs": lambda n: "<center>" * n + "<p>x" * n,
        "unfinished tags": lambda n: "<a " * n,
        "unfinished comments": lambda n: "<p>t</p>" + "<!" * n,
        "unclosed raw": lambda n: "<svg>" * n + "t",
        "nested articles": lambda n: "<article>text " * n,
        "stray ends": lambda n: "<i>" * n + "</b>" * n,
        "quotes": lambda n: "<a title='x\"" * n + ">",
        "list in list": lambda n: "<ul><li>a " * n,
    }
    for name, shape in shapes.items():
        took = []
        for n in (20_000, 80_000):
            page = shape(n).encode()
            began = time.time()
            main_text(page)
            took.append(time.time() - began)
        assert took[1] < 8 * took[0] + 1, (name, took)


def test_noise_names_are_lower_case_words():
    assert all(re.fullmatch("[a-z]+", w) for w in html_text.WORDS)
