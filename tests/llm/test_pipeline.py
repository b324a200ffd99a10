"""The corpus pipeline against a brute-force version of its stages, on odd and empty tables."""

import re
from collections import Counter

import pytest
from tests.llm.test_operators import brute_components, brute_repeats

import corpus_pipeline as pipeline
from trackweave.llm import bpe, langid, mixing
from trackweave.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def brute_one(docs):
    """Names of the rows that stay, then each exact row once; rows without id come last in their groups."""
    every = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0, repr(r)))
    name = {k: r for k, r in enumerate(every)}
    root = brute_components({k: r[1] for k, r in name.items()})
    ids = {k: r[0] if r[0] is not None else (1 << 62) + k for k, r in name.items()}
    stays = {ids[k] for k in name if ids[root[k][1]] == ids[k]}
    return Counter(r for k, r in name.items() if ids[k] in stays)


def brute_rest(docs):
    # rows with the same doc_id have the same text here; without doc_id all is kept
    found = brute_repeats({r[0]: r[1] for r in docs if r[0] is not None})
    out = Counter()
    for r in docs:
        data = found[r[0]][2] if r[0] is not None else (r[1] or "").encode()
        text = data.decode(errors="ignore")
        if re.search(r"[^\x09-\x0D\x20]", text):
            out[(r[0], text, *r[2:4], len(text))] += 1
    return out


def check_mixed(before, after):
    """Each row as often as it is there at least, at most twice that often and its source once at least."""
    have, used = Counter(before), Counter(after)
    assert set(have) == set(used)
    assert all(have[r] <= used[r] <= 3 * have[r] for r in have)


@pytest.fixture
def odd(odd_docs):
    return odd_docs.select(*pipeline.COLUMNS)


def test_one_of_each(spark, odd):
    got = Counter(rows(pipeline.one_of_each(spark, odd, "")))
    assert got == brute_one(rows(odd)) and max(got.values()) == 1


def test_one_of_each_names_groups_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(None, text, "en", "a", 1), (None, text, "en", "b", 2), (None, text, "en", "b", 2), (None, "other words", None, "", 3), (7, "more of it", None, None, None)]
    got = rows(pipeline.one_of_each(spark, spark.createDataFrame(docs, SCHEMA), ""))
    assert sorted(r[1] for r in got) == sorted(["more of it", "other words", text])


def test_without_repeats(spark, odd):
    assert Counter(rows(pipeline.without_repeats(spark, odd, ""))) == brute_rest(rows(odd))


def test_without_repeats_keeps_replacement_characters_of_the_text(spark):
    passage = "".join(chr(0x4E00 + k) for k in range(40))
    docs = [(1, "é" + passage + "è", "en", "s", 1), (2, "\ufffd a\x01b \x01a è" + passage + "ê \ufffd\x01", "en", "s", 1)]
    got = {r[0]: r[1] for r in rows(pipeline.without_repeats(spark, spark.createDataFrame(docs, SCHEMA), ""))}
    assert got == {1: docs[0][1], 2: "\ufffd a\x01b \x01a è \ufffd\x01"}


def test_mixed_keeps_null_ids_and_each_row_has_its_own_uses(spark, odd):
    mixed = rows(pipeline.mixed(spark, odd, ""))
    check_mixed(rows(odd), mixed)
    assert len(mixed) == mixing.mix(odd).count()


def test_mixed_of_rows_that_share_an_id(spark):
    docs = [(1, "a b c", "en", "s", 5)] * 4 + [(1, "a b d", "en", "s", 5), (1, "a b c", None, "s", 5), (1, "a b c", "", "s", 5), (None, "x y", "en", None, 3), (None, "x y", "en", "", 3)]
    mixed = rows(pipeline.mixed(spark, spark.createDataFrame(docs, SCHEMA), ""))
    check_mixed(docs, mixed)
    assert len(mixed) == mixing.mix(spark.createDataFrame(docs, SCHEMA)).count()


def test_known_language(spark, odd):
    judged = langid.identify(odd).collect()
    got = Counter(r[0] for r in rows(pipeline.known_language(spark, odd, "")))
    assert got == Counter(r.doc_id for r in judged if r.lang_pred != langid.UNKNOWN and r.score >= pipeline.LEAST_SCORE)


def test_encoded(spark, odd):
    import hashlib

    codec = bpe.BytePairCodec(bpe.vocabulary_text(vocabulary()))
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in pipeline.encoded(spark, odd, "").collect())
    want = Counter()
    for r in rows(odd):
        ids = codec.encode(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(codec.decode(ids).encode()).hexdigest())] += 1
    assert got == want


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_on_an_empty_table(spark, no_docs, name):
    assert dict(pipeline.STAGES)[name](spark, no_docs.select(*pipeline.COLUMNS), "").count() == 0


def test_run_is_the_stages_in_order(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    kept = rows(pipeline.known_language(spark, odd, ""))
    rest = list(brute_rest(list(brute_one(kept).elements())).elements())
    uses = Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect())
    assert kept and set(uses) == {r[0] for r in rest} and sum(uses.values()) >= len(rest)
