import base64
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from sparrowql.llm import decontamination as D
from sparrowql.llm.passages import words
from tests.llm.test_decontamination import fit
from tests.llm.test_jaccard import brute_classes
from tests.llm.test_quality import brute as quality
from tests.llm.test_secrets import brute as base_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyzuvw") * rng.randint(1, 4) for _ in range(n))
    items = [draw(rng.randint(20, 40)) for _ in range(6)]
    texts = [draw(rng.randint(20, 200)) for _ in range(120)]
    texts += [t + " more" for t in texts[:30]] + texts[10:20] + [None, "", "from " * 300]
    texts += [f"{draw(60)}\n{rng.choice(items)}\n{draw(30)}" for _ in range(20)]
    texts += [f'{draw(70)} token = "04dbebab91ab85687d33eeaaf9ac699e1188f96{k}" {draw(9)}' for k in range(10)]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows, items


def test_stages_equal_brute_force(spark, folder):
    top, rows, items = folder
    left = [r for r in rows if not quality(r[1])[-1]]
    classes = brute_classes([r[1] for r in left])  # five-word Jaccard of 0.8 or more
    left = [r for k, r in enumerate(left) if classes.index(classes[k]) == k]
    clean = lambda t: all(fit(words(i), words(t)) > D.edit_bound(len(words(i))) for i in items)
    left = [r for r in left if clean(r[1])]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text, lang, source, _ in left:
        for start, _, end in sorted(base_spans(text), reverse=True):
            if not any(a <= start < b and (a, b) != (start, end) for a, _, b in base_spans(text)):
                text = text[:start] + "<SECRET>" + text[end:]
        if text.count('<SECRET>"') != rows[i][1].count('token = "'):
            raise AssertionError(text)
        want[i] = (text, lang, source, len(text), library.encode_ordinary(text))
    out = corpus_pipeline.run(spark, top)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens", "round_trip"]
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars, r.token_ids) for r in out.collect()}
    assert 60 < len(got) < 150 and got == want
    assert out.where("not round_trip or n_tokens <> size(token_ids)").count() == 0


def test_every_stage_keeps_the_columns_and_takes_an_empty_table(spark, folder):
    top, _, _ = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), top)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_null_and_repeated_ids_and_clashing_names(spark, folder):
    """Rows of one id with different texts, rows without an id, repeated rows, and columns named like the operators' own."""
    top, rows, _ = folder
    texts = [r[1] for r in rows[:12]]
    made = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " more"), (3, texts[3]), (4, texts[3] + " more"), (5, None), (5, ""), (None, None)]
    extra = "lang string, source string, n_chars long, kept int, key string, part long, fp long, id int, held int, n_words string, stratum string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2, 3, 4, 5, "w", None) for i, t in made], f"doc_id long, text string, {extra}")
    good = [(i, t) for i, t in made if not quality(t)[-1]]
    classes = brute_classes([t for _, t in good])
    least = {}
    for (i, _), c in zip(good, classes, strict=True):
        least[c] = min(x for x in (i, least.get(c)) if x is not None) if i is not None or least.get(c) is not None else None
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, out, top).collect(), stage(spark, out, top).schema)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality_rules":
            assert sorted(got, key=str) == sorted(good, key=str)
        elif name == "near_dedup":
            assert sorted((i for i, _ in got), key=str) == sorted(least.values(), key=str)
            assert len({brute_classes([t for _, t in good] + [t])[-1] for _, t in got}) == len(got)
    assert out.where("round_trip").count() == out.count() > 0
