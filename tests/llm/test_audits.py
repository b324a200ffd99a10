"""Filter interaction, source divergence and decontamination against brute-force versions and on odd tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trackweave.llm import audit, decontaminate, divergence

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11 filter interaction


def brute_audit(docs, labels, m):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = [(i, t or "", lang or "") for i, t, lang in docs]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    failed = []
    for i, t, part in texts:
        w = WORDS.findall(t)
        f = {
            "A": len(w) < m.least_words,
            "B": 100 * len(set(w)) < m.least_distinct * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > m.most_capitals * len(t),
            "D": any(c in m.symbols for c in t),
            "E": i is not None and i > least[t],
        }
        failed.append((i, part, {x for x in f if f[x]}))
    out = []
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        shapley = Counter()
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in left if x in f]
                redundant = sum(x in f for _, f in own) - len(removed)
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(removed)
                alone = sum(f == {x} for _, f in own)
                rows.append((part, order, step, x, len(left), len(removed), redundant, alone, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
        out += [(*r[:3], *r[4:], shapley[r[3]]) for r in rows]
    return sorted(out, key=repr)


def test_audit_against_brute_force(spark):
    r = random.Random(3)
    docs = []
    for k in range(150):
        words = [r.choice(["the", "of", "it", "a#b", "SHOUT", "x", "é"][: r.choice([3, 5, 7])]) for _ in range(r.randint(0, 12))]
        docs.append((k if k % 11 else None, r.choice([" ", "\t", "  "]).join(words), r.choice(["en", "de", None])))
    docs += [docs[7], docs[7], (5, "other text of this id", "en"), (None, None, None), (-1, None, "de"), (400, "", "de")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 140, 2)] + [(4, 1, 1), (None, 1, 1)]
    m = audit.AuditedFilters(least_words=6, most_capitals=30)
    got = audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), m)
    assert rows_of(got) == brute_audit(docs, labels, m)


def test_audit_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert rows_of(audit.filter_audit(odd_docs, labels)) == brute_audit(rows, [(0, 1, 0)], audit.AuditedFilters())
    assert audit.filter_audit(no_docs, labels).count() == 0
    assert audit.filter_audit(odd_docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# 12 source divergence


def brute_divergence(docs, m):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    texts = [(lang or "", source or "", term.findall(lower(t))) for t, lang, source in docs]
    out = []
    for lang in {x for x, _, _ in texts}:
        own = [(s, t) for x, s, t in texts if x == lang]
        in_docs = Counter(w for _, t in own for w in set(t))
        kept = {w for w, n in in_docs.items() if n >= m.documents}
        n = defaultdict(Counter)
        for s, t in own:
            n[s].update(w for w in t if w in kept)
        everything = sum(n.values(), Counter())

        def shares(c, kept=kept):
            of = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // of for w in kept}

        p, q = {s: shares(n[s]) for s in n}, shares(everything)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in n if o != s)
            marks = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if n[s][w] and p[s][w] > q[w])[: m.top]
            out += [(lang, s, part, item.decode(), -v, k) for part, rows in (("pair", pairs), ("term", marks)) for k, (v, item) in enumerate(rows, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [64, 2])
def test_divergence_against_brute_force(spark, block):
    r = random.Random(9)
    vocabulary = [a + b for a in "abéAZ" for b in ("x", "y", "", "ß")]
    docs = [(" ".join(r.choice(vocabulary[k % 5 :]) for _ in range(r.randint(0, 30))), ["en", "fr", None][k % 3], r.choice(["s1", "s2", "s3", "s4", "s5", None, "é"])) for k in range(220)]
    docs += [docs[0], docs[0], (None, "en", "only null"), ("word", "xx", "alone"), (None, "yy", "a"), ("1 2 3", "yy", "b")]
    m = divergence.Divergence(documents=4, top=5, block=block, held=50)
    got = divergence.source_divergence(spark.createDataFrame(docs, "text string, lang string, source string").repartition(3), m)
    assert rows_of(got) == brute_divergence(docs, m)


def test_divergence_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    m = divergence.Divergence(documents=2)
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert rows_of(divergence.source_divergence(odd_docs, m)) == brute_divergence(rows, m)
    assert divergence.source_divergence(no_docs).count() == 0


# 13 decontamination


def cut(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def brute_hits(docs, items, window):
    windows = {}
    for item, text in items:
        w = cut(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if of := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= of
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def hit_rows(df):
    return sorted(((r.doc_id, r.n_words, r.n, list(r["items"])) for r in df.withColumn("n", decontaminate.hit_words()).collect()), key=repr)


def scene(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "C", "é1", "7"])
    items = [(k // 2 if k % 5 else 50 + k, " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 4, 5, 9, 30])))) for k in range(12)]
    items += [(None, "a a b b"), (98, None), (99, items[3][1])]
    docs = []
    for k in range(60):
        text = " ".join(word() for _ in range(r.randint(0, 25)))
        if k % 3 == 0:
            passage = (r.choice(items)[1] or "").split()
            a = r.randrange(len(passage) + 1)
            text += "\n" + "-".join(passage[a : a + 8]) + "."
        docs.append((k if k % 13 else None, text))
    return docs + [docs[1], docs[1], (-1, None), (None, None), (1, "another text of b b C")], items


@pytest.mark.parametrize(("window", "block_words", "piece_words"), [(3, 10**6, 10**6), (5, 10**6, 4), (4, 20, 6), (10, 15, 3)])
def test_hits_against_brute_force(spark, window, block_words, piece_words):
    for seed in range(3):
        docs, items = scene(seed)
        m = decontaminate.Decontamination(window=window, block_words=block_words, piece_words=piece_words)
        got = decontaminate.find_hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), m)
        assert hit_rows(got) == brute_hits(docs, items, window)


def test_automaton_knows_every_run_and_no_other(spark):
    r = random.Random(1)
    for _ in range(60):
        made = decontaminate.SuffixAutomaton(3)
        items = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 14))] for _ in range(4)]
        for words in items:
            made.add(words)
        runs = {tuple(w[i:j]) for w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        text = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        longest = {k: n for k, _, n in made.walk(text)}
        for k in range(len(text)):
            assert longest.get(k, 0) == max((n for n in range(1, k + 2) if tuple(text[k + 1 - n : k + 1]) in runs), default=0)
        assert len(made.length) <= 2 * sum(map(len, items))


def test_removal_of_spans_and_of_covered_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it, {passage.upper()}! And after; " + "more words " * 20), (2, passage + " x"), (3, "clean é text"), (4, None), (5, ""), (3, "clean é text")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("q1", passage)], "item_id string, text string"))
    found = sorted(((r.doc_id, r.kept, r.n_hit, r["items"], r.dropped) for r in got.collect()), key=repr)
    assert found == sorted([(1, "Before it, ! And after; " + "more words " * 20, 11, ["q1"], False), (2, None, 11, ["q1"], True), (3, "clean é text", 0, [], False), (3, "clean é text", 0, [], False), (4, None, 0, [], False), (5, "", 0, [], False)], key=repr)


def test_hits_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(0, "passage1 of words that repeat passage2 of words that repeat"), (1, "w5 w6"), (2, "")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert hit_rows(decontaminate.find_hits(odd_docs, items)) == brute_hits(rows, [tuple(r) for r in items.collect()], 10)
    assert decontaminate.find_hits(no_docs, items).count() == 0
    assert decontaminate.find_hits(odd_docs, items.limit(0)).where(F.size("runs") > 0).count() == 0
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).count() == len(rows)
