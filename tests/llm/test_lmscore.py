from collections import Counter
from math import ceil, log

import pytest

from landgrid.llm.lmscore import Plan, op5_lm_scoring, score


def brute(rows, targets, plan):
    """Both models without a document's own counts, written out. All documents are in the sample."""
    texts = [[None, *(text or "").lower().split()] for _, text in rows]
    held = Counter(u for words in texts for u in {*words[1:], *zip(words, words[1:])})
    common = {u for u, n in held.items() if n >= max(2, ceil(plan.common * min(plan.sample_docs, len(rows))))}
    pairs = {u for u in common if isinstance(u, tuple)}
    ends = Counter(a for a, _ in pairs)
    bags = []  # of each text: pairs and words alone, contexts, contexts with another word behind them
    for words in texts:
        steps = list(zip(words, words[1:]))
        bags.append((Counter(s if s in pairs else s[1] for s in steps), Counter(a for a, _ in steps if a in ends), Counter(s[0] for s in steps if s[0] in ends and s not in pairs)))
    sums = [[Counter(), Counter(), Counter()] for _ in "tb"]
    words = [0, 0]
    for (d, _), bag in zip(rows, bags, strict=True):
        for i in (0, 1) if d in targets else (1,):
            words[i] += sum(bag[0].values())
            for mine, own in zip(sums[i], bag, strict=True):
                mine.update(own)
    kinds = len({u for u in sums[1][0] if u not in pairs} | {u for u in common if u not in pairs})
    least = min((t for t in words if t), default=1)
    alone = lambda bag: sum(n for u, n in bag.items() if u not in pairs)
    out = []
    for (d, _), bag in zip(rows, bags, strict=True):
        n, losses = sum(bag[0].values()), []
        for i, own in ((0, bag if d in targets else [Counter()] * 3), (1, bag)):
            s = min(1.0, least / words[i]) if words[i] else 1.0
            grams, behind, free = (lambda u, k=k: s * (sums[i][k][u] - own[k][u]) for k in range(3))  # noqa: B023
            loss = 0.0
            for u, k in bag[0].items():
                if u in pairs:  # P(end | begin)
                    loss -= k * log((grams(u) + plan.alpha) / (behind(u[0]) + plan.alpha * (1 + ends[u[0]])))
                else:
                    loss -= k * log((grams(u) + plan.alpha) / (s * (alone(sums[i][0]) - alone(own[0])) + plan.alpha * kinds))
            for a, k in bag[2].items():  # the share of any other word behind a
                loss -= k * log((free(a) + plan.alpha) / (behind(a) + plan.alpha * (1 + ends[a])))
            losses.append(loss / n if n else None)
        out.append((d, n, *losses))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("plan", [Plan(), Plan(common=0.5, bucket_words=500), Plan(common=1.0, bucket_words=7)])
def test_losses_match_brute_force(spark, docs, plan):
    targets = {1, 3, 7, 105, 106}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    ids = spark.createDataFrame([(i,) for i in [*targets, 1, 999, None]], "doc_id long")
    got = order([(r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in score(docs, ids, plan).collect()])
    for mine, want in zip(got, order(brute(rows, targets, plan)), strict=True):
        assert mine[:2] == want[:2] and mine[2:] == pytest.approx(want[2:], abs=1e-9)


def test_no_target_and_empty_table(docs, empty):
    rows = score(docs, empty).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], set(), Plan())
    for mine, theirs in zip(order([(r.doc_id, r.n_tokens, r.target_loss) for r in rows]), order([w[:3] for w in want]), strict=True):
        assert mine[:2] == theirs[:2] and mine[2] == pytest.approx(theirs[2], abs=1e-9)
    assert all(r.score is None for r in rows if not r.n_tokens) and score(empty, docs).count() == 0


def test_texts_like_the_target_score_lower(spark):
    good = [(i, f"the river runs past the old mill and the bridge number {i}") for i in range(30)]
    bad = [(100 + i, f"click here to win the big prize today offer {i}") for i in range(30)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in score(docs, docs.where("doc_id < 15").select("doc_id")).collect()}
    assert max(rows[i] for i in range(30)) < min(rows[100 + i] for i in range(30))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "one two three four " * 280_000), (2, "two three")], "doc_id long, text string")
    rows = {r.doc_id: r for r in score(docs, docs.where("doc_id = 1")).collect()}
    assert rows[1].n_tokens == 1_120_000 and rows[2].background_loss < 15


def test_query_scores_every_document(spark):
    rows = op5_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all((r.score is None) == (r.n_tokens == 0) for r in rows)


def test_probabilities_behind_a_word_add_up(spark):
    """Behind one context: the ends of its pairs and any other word have a total probability of one."""
    texts = ["a b c", "a b d", "a c b", "a d", "e a b", "x a c"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = Plan(common=0.1)
    rows = [(i, t) for i, t in enumerate(texts)]
    common = {u for u, n in Counter(u for t in texts for u in {*zip([None, *t.split()], t.split())}).items() if n >= 3}
    behind = Counter(p[0] for t in texts for p in zip([None, *t.split()], t.split()))
    pair = Counter(p for t in texts for p in zip([None, *t.split()], t.split()))
    ends = [p for p in common if p[0] == "a"]
    ways = 1 + len(ends)
    total = sum((pair[p] + plan.alpha) / (behind["a"] + plan.alpha * ways) for p in ends) + (behind["a"] - sum(pair[p] for p in ends) + plan.alpha) / (behind["a"] + plan.alpha * ways)
    assert abs(total - 1) < 1e-12
    got = {r.doc_id: r.background_loss for r in score(docs, docs.select("doc_id"), plan).collect()}
    assert {d: pytest.approx(g, abs=1e-9) for d, _, _, g in brute(rows, set(range(len(rows))), plan)} == got


def test_one_word_a_million_times_in_one_document(spark):
    docs = spark.createDataFrame([(1, "rare " * 1_000_000), *[(2 + i, f"some other words here {i}") for i in range(30)]], "doc_id long, text string")
    rows = {r.doc_id: r for r in score(docs, docs.where("doc_id > 20").select("doc_id"), Plan(bucket_words=1000)).collect()}
    assert rows[1].n_tokens == 1_000_000 and len(rows) == 31 and all(r.score is not None for r in rows.values())


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_common_units_are_counted_over_all_documents(spark, block):
    from random import Random

    import numpy as np

    from landgrid.llm.lmscore import Words, common_units, pair_hashes, word_hashes

    rng = Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    held = Counter()
    for text in texts:
        own = word_hashes(Words(), text)
        held.update({*own.tolist(), *pair_hashes(own).tolist()})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    plan = Plan(common=0.05, sample_docs=block)
    found = common_units(docs, plan)
    want = sorted(u for u, n in held.items() if n >= ceil(0.05 * len(texts)))
    assert found.units.tolist() == want and len(want) > 20
    assert (found.begins >= 0).sum() > 5 and found.begins.max() == len(found.contexts) - 1 and np.all(np.diff(found.contexts.astype(float)) > 0)


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """All passes read the hashes that one call writes; their rows have no text."""
    from landgrid.llm import lmscore

    calls, whole = [], lmscore.hashed
    monkeypatch.setattr(lmscore, "hashed", lambda rows: calls.append(whole(rows)) or calls[-1])
    docs = spark.createDataFrame([(i, f"some words {i % 7} and {i % 3}") for i in range(58)] + [(58, None), (59, "")], "doc_id long, text string")
    assert score(docs, docs.where("doc_id < 20").select("doc_id")).count() == 60
    assert [sorted(c.columns) for c in calls] == [["doc_id", "hashes", "target"]]
