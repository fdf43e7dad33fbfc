"""Key phrases against plain loops, in runs of any size, and the plan behind them."""

import re
from collections import Counter, defaultdict
from math import log
from statistics import fmean, pstdev

import pytest

from quillgraph.functions.text import SENTENCE, STOP_WORDS
from quillgraph.operators import terms as te

TEXTS = [
    (1, "Graph engines rank nodes. Graph engines rank the nodes of large graphs! Fast engines, slow engines: rank of nodes\nrank them"),
    (2, "One two one two one two. two one"), (3, None), (4, ""), (5, "!!! ... ,"), (6, "the and of"), (7, "word"), (8, "Ärger über Äpfel. Birnen-Saft isn't Apfel's Saft"),
    (9, "Twice said things. Said things twice"), (9, "Twice said things. Said things twice"), (None, "beta alpha. gamma beta alpha"),
    (10, " ".join(f"w{i % 7} v{i % 5}" + "." * (i % 9 == 0) for i in range(80))), (10, None),
]


def loops(texts, keep):
    docs = defaultdict(list)
    for i, text in texts:
        for s, line in enumerate(re.findall(SENTENCE, text or "")):
            for p, token in enumerate(re.findall(r"[^\W_]+(?:[-'][^\W_]+)*|[^\s\w]", line)):
                docs[i].append((s, p, token.lower() if token[0].isalnum() else None))
    out = {}
    for i, rows in docs.items():
        rows.sort(key=lambda r: r[:2])
        seen, sides = defaultdict(list), defaultdict(lambda: ([], []))
        for k, (s, _, w) in enumerate(rows):
            if w is not None:
                seen[w].append(s)
                for side, j in enumerate((k - 1, k + 1)):
                    if 0 <= j < len(rows) and rows[j][0] == s and rows[j][2] is not None:
                        sides[w][side].append(rows[j][2])
        content = {w: len(s) for w, s in seen.items() if w not in STOP_WORDS}
        score = {}
        for w, tf in content.items():
            rel = 1 + sum(len(set(x)) / len(x) for x in sides[w] if x) * tf / max(map(len, seen.values()))
            score[w] = rel * log(log(min(seen[w]) + 3)) / (tf / (fmean(content.values()) + pstdev(content.values())) / rel + len(set(seen[w])) / (rows[-1][0] + 1) / rel)
        found, number = defaultdict(list), Counter()
        for k in range(len(rows)):
            for n in range(2, 6):
                part = rows[k:k + n]
                words = [w for _, _, w in part]
                if len(part) == n and len({s for s, _, _ in part}) == 1 and None not in words and words[0] in score and words[-1] in score:
                    product, total = 1.0, 0.0
                    for w in words:
                        product, total = product * score.get(w, 1.0), total + score.get(w, 0.0)
                    found[" ".join(words)].append((product, total))
                    number[" ".join(words)] += 1
        value = {w: None if i is None else min(p for p, _ in x) / (number[w] * (1 + min(t for _, t in x))) for w, x in found.items()}
        best = sorted(value, key=lambda w: (0 if i is None else round(value[w], 12), w.encode()))[:keep]
        out |= {(i, rank): (w, value[w]) for rank, w in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("run", [1, 60, 1 << 20])
@pytest.mark.parametrize("keep", [1, 10])
def test_against_loops(spark, monkeypatch, run, keep):
    monkeypatch.setattr(te, "PAIRED_TOKENS", run)
    got = te.extract_keywords(spark.createDataFrame(TEXTS, "id bigint, text string"), keep=keep).collect()
    wanted = loops(TEXTS, keep)
    assert len(got) == len(wanted)
    for r in got:
        word, score = wanted[r.id, r["rank"]]
        assert r.keyword == word and (r.score is None if score is None else r.score == pytest.approx(score, rel=1e-12))


def test_no_token_moves(spark):
    """Texts move once, and then only the phrases that are kept."""
    found = te.extract_keywords(spark.createDataFrame(TEXTS, "id bigint, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2 and "Join" not in plan and "Generate" not in plan
