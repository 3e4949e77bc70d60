import re
from collections import Counter
from math import log2, sqrt

from landgrid.llm.quality import COMMON, OP6_SQL, judge, keep_good, op6_quality_rules
from tests.compare import connect, differences

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts_match_brute_force(docs, empty):
    got = judge(docs).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:7] == brute(r.text)
        assert not (r.base_failed and r.kept)
    assert judge(empty).count() == 0 and keep_good(empty).count() == 0


def test_filter_on_the_verdict(docs):
    every = judge(docs).select("row.doc_id", "kept").collect()
    assert sorted(str(r.doc_id) for r in judge(docs).where("kept").select("row.doc_id").collect()) == sorted(str(r.doc_id) for r in every if r.kept)


def test_word_distance_matches_brute_force(docs):
    counts = Counter()
    for r in docs.where("lang = 'en'").select("text").collect():
        counts.update(re.findall(WORD, (r.text or "").lower()))
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:COMMON]
    q = [n / sum(counts.values()) for _, n in top]
    q.append(1 - sum(n for _, n in top) / sum(counts.values()))
    for r in judge(docs).where("row.lang = 'en' AND word_distance IS NOT NULL").select("row.text", "word_distance").collect():
        own = Counter(re.findall(WORD, r.text.lower()))
        n = sum(own.values())
        p = [own[w] / n for w, _ in top]
        p.append(1 - sum(p))
        half = lambda a, b: sum(x * log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        assert abs(r.word_distance - sqrt(max(0, (half(p, q) + half(q, p)) / 2))) < 1e-6


def test_only_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    rows = judge(docs).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_plan_has_no_python(docs):
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_agrees_with_sql(spark):
    assert differences(op6_quality_rules(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), OP6_SQL) == ""
