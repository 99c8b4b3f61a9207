"""Line dedup against a slow twin: every line is compared with every template of its leaf."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from graphloom.llm.line_dedup import LEAD, Lines, dedup_lines

ANY = None


def order_of(lines):
    """The hashes that lines meet their leaf by."""
    table = pa.table({"doc_id": [0], "text": ["\n".join(lines)]})
    found = Lines(table, 1)
    return dict(zip(lines, found.key.tolist(), strict=True))


def slow(rows, min_docs=2, min_words=3, alike=0.7, short_docs=5):
    """(doc_id, text) -> kept texts."""
    digits = set("0123456789")
    docs_of = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if line.split():
                docs_of[tuple(line.split())].add(d)
    long = [w for w in docs_of if len(w) >= min_words]
    shape = {w: tuple(ANY if digits & set(x) else x for x in w) for w in long}
    leaves = defaultdict(set)
    for s in shape.values():
        leaves[len(s), s[:LEAD]].add(s)
    one = {" ".join("0" if x is ANY else x for x in s): s for leaf in leaves.values() for s in leaf}
    key = {one[line]: k for line, k in order_of(list(one)).items()}
    template_of = {}
    for leaf, lines in leaves.items():
        templates = []
        for s in sorted(lines, key=key.get):
            scores = [sum(a == b for a, b in zip(t, s, strict=True)) for t in templates]
            best = max(scores, default=-1)
            if best >= alike * len(s) - 1e-9:
                n = scores.index(best)
                templates[n] = [a if a == b else ANY for a, b in zip(templates[n], s, strict=True)]
            else:
                n = len(templates)
                templates.append(list(s))
            template_of[s] = (leaf, n)
    members = defaultdict(set)
    for w in long:
        members[template_of[shape[w]]] |= docs_of[w]
    out = []
    for d, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            w = tuple(line.split())
            docs = members[template_of[shape[w]]] if len(w) >= min_words else docs_of.get(w, set())
            if not w or len(docs) < (min_docs if len(w) >= min_words else short_docs) or d == min(docs):
                kept.append(line)
        out.append((d, None if t is None else "\n".join(kept)))
    return sorted(out)


def lines_by_chance(seed):
    r = random.Random(seed)
    words = ["ab", "cd", "ef", "g7", "8", "hi"]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            base = ["x"] * LEAD + [r.choice(words) for _ in range(r.randint(0, 7))] if r.random() < 0.6 else [r.choice(words) for _ in range(r.randint(0, 4))]
            lines.append(" ".join(base))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines(spark, seed):
    rows = lines_by_chance(seed)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_docs=2, short_docs=5)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == slow(rows)


def test_small_table(spark, small_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    from graphloom.llm import queries

    got = queries.op10_line_dedup(spark, small_dir)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == slow(rows)
