"""Language identification, quality scores and the class-based model."""

import math
import pickle
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import brown, language, quality

LANGUAGES = {"en": "the of and ing tion er hat th wh", "de": "der ung ich sch keit pf ein zu tz", "es": "los ción mente ar ñor ja del que es"}


def prose(lang, rng, n):
    parts = LANGUAGES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def labelled(n, seed, words=(20, 60)):
    rng = random.Random(seed)
    return [(i, prose(lang := rng.choice(list(LANGUAGES)), rng, rng.randint(*words)), lang) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, score double, `of` string"
ODD = [None, "", " \n", "12 !! ² ½ 34", "a", "word " * 60_000, "THE OF AND!!", "日本語"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "") for r in rows], SCHEMA)


def test_language_on_held_out_rows(spark):
    docs = frame(spark, labelled(600, 1))
    train = F.pmod("doc_id", F.lit(4)) != 2
    model = language.fit_languages(docs, train)
    got = language.identify(docs.where(~train), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    # Held-out labels are never seen: other ones give the same model.
    other = docs.withColumn("lang", F.when(train, F.col("lang")).otherwise("zz"))
    assert language.fit_languages(other, train).content == model.content


def test_language_of_odd_texts(spark):
    model = language.fit_languages(frame(spark, labelled(200, 2)))
    docs = frame(spark, [(i, t, None) for i, t in enumerate(ODD)])
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(got) == len(ODD)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in range(4))
    assert all(got[i]["lang_pred"] in LANGUAGES for i in range(4, len(ODD))) and got[6]["lang_pred"] == "en"
    assert language.identify(docs.limit(0), model).count() == 0
    empty = language.fit_languages(docs)
    assert empty.content == {} and {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}
    one = language.LanguageModel({"xx": language.dictionary(Counter(b"some words here".split()))})
    assert one.predict("words") == ("xx", 1.0, False)


def test_staged_tables_can_be_dropped(spark):
    from tessera.llm._common import drop_staged, staged

    kept = staged(spark.range(3), "some")
    assert kept.count() == 3
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    drop_staged(spark)
    assert not folder.exists()


def test_narrow_margins_are_rejected():
    model = language.LanguageModel({"a": b" same same words ", "b": b" same same words "})
    lang, score, rejected = model.predict("same words")
    assert (lang, score, rejected) == ("a", 0.0, True)
    assert pickle.loads(pickle.dumps(model)).predict("same words") == (lang, score, rejected)


def spoiled(text, rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(("$$$", "%%%", "***")) for w in text.split())
    if kind == 1:
        return text.upper().replace(" ", "!! ")
    return " ".join([text.split()[0]] * len(text.split()))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i, t, lang in labelled(700, 4):
        bad = rng.random() < 0.25
        rows.append((i, spoiled(t, rng) if bad else t, lang))
        if i % 5:
            marks.append((i, int(not bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame([*marks, (99_999, 1), (3, None)], "doc_id long, quality int")
    train = F.pmod("doc_id", F.lit(4)) != 2
    model = quality.fit_quality(docs, labels, train)
    got = quality.scores(docs.where(~train), model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in got]) > 0.95
    flipped = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    again = quality.fit_quality(docs, flipped, train)
    assert again.temperature == model.temperature and np.array_equal(again.layers[0], model.layers[0])
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.scores(docs, model).collect() if r["score"] >= 0.7}
    assert {r["doc_id"] for r in kept.collect()} == good


def test_quality_of_odd_texts(spark):
    docs = frame(spark, [(i, t, None) for i, t in enumerate([*ODD, "a", "a"])])
    none = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.scores(docs, none).collect()} == {0.5}
    model = quality.fit([t for _, t, _ in labelled(60, 5)] + ["$$$ !!!"] * 20, [1] * 60 + [0] * 20)
    got = quality.scores(docs, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1
    assert quality.scores(docs.limit(0), model).count() == 0


def test_languages_equal_plain_compression(spark):
    """Dictionaries and predictions from their definition: the sample's words by frequency, then every block with every dictionary."""
    import zstandard

    rows = labelled(90, 8)
    rows += [(1000 + i, *rows[3][1:]) for i in range(500)]
    model = language.fit_languages(frame(spark, rows), sample_rows=1000)
    words: dict[str, Counter] = {}
    for text, lang in {(t, x) for _, t, x in rows}:
        words.setdefault(lang, Counter()).update(re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode().split())
    assert list(model.content) == sorted(words, key=lambda x: (-words[x].total(), x))
    for lang, counts in words.items():
        assert model.content[lang] == b" " + b" ".join(sorted(counts, key=lambda w: (counts[w], [-b for b in w], -len(w)))) + b" " or sorted(model.content[lang].split()) == sorted(counts)
    for r in language.identify(frame(spark, labelled(60, 9, (1, 300))), model).join(frame(spark, labelled(60, 9, (1, 300))).select("doc_id", "text"), "doc_id").collect():
        raw = re.sub(r"[\W\d_]+", " ", r["text"].lower()).strip().encode()
        sizes = {}
        for lang, content in model.content.items():
            packer = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
            sizes[lang] = sum(len(packer.compress(raw[k : k + language.BLOCK])) for k in range(0, len(raw), language.BLOCK))
        least = min(sizes.values())
        assert abs(sizes[r["lang_pred"]] - least) <= 2


def test_samples_are_bounded_and_repeats_count_once(spark):
    rows = labelled(60, 3)
    plain = language.fit_languages(frame(spark, rows))
    again = language.fit_languages(frame(spark, rows + [(500 + i, *rows[0][1:]) for i in range(10_000)]))
    assert again.content == plain.content
    many = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    model = language.fit_languages(many.unionByName(frame(spark, rows).select("doc_id", "text", "lang")), languages=20)
    assert len(model.content) == 20 and set(LANGUAGES) <= set(model.content)
    texts = [(i, t, None) for i, t, _ in rows]
    docs, marks = frame(spark, texts + [texts[0]] * 10_000), spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, quality int")
    a, b = (quality.fit_quality(d, marks, sample_rows=50) for d in (docs, frame(spark, texts)))
    assert a.known == b.known and np.array_equal(a.layers[0], b.layers[0])
    small = quality.fit_quality(frame(spark, texts), marks, sample_bytes=2000)
    assert len(small.known) < len(a.known)


def test_scores_equal_a_plain_network():
    """A document at a time and a word at a time: mean of token vectors, its length, distinct words, log length, two layers, temperature."""
    rng = random.Random(4)
    texts = [t if i % 4 else spoiled(t, rng) for i, t, _ in labelled(120, 7)]
    model = quality.fit(texts, [int(i % 4 > 0) for i in range(120)])

    def vector(token):
        return model.vectors[model.known[token]] if token in model.known else quality.index_vectors([token])[0]

    for text in ["", "a", "Some NEW words!! 12", *texts[:30]]:
        own = text.split()
        pooled = np.zeros(quality.DIM + 3)
        if own:
            vectors = []
            for w in own:
                shape = "".join("X" if m[1] else "x" if m[2] else "0" if m[3] else m[0][:3] for m in quality._SHAPES.finditer(w))[:24]
                vectors.append((vector("".join(re.findall(r"[^\W\d_]+", w)).lower()) + vector("\0" + shape)) / 2)
            pooled[: quality.DIM] = np.mean(vectors, 0)
            pooled[quality.DIM :] = np.linalg.norm(pooled[: quality.DIM]), len(set(own)) / len(own) ** 0.9, np.log1p(len(own))
        w1, b1, w2, b2 = model.layers
        logit = np.maximum(((pooled - model.shift) / model.scale) @ w1 + b1, 0) @ w2 + b2
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-logit / model.temperature)), abs=1e-4)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("head, core", [(100_000, 50), (60, 20), (0, 20)])
def test_unigrams_and_classes(spark, head, core):
    rows = [*labelled(150, 6), *((1000 + i, t, None) for i, t in enumerate(ODD)), (3000, "only here only", None)]
    docs = frame(spark, rows)
    held = lambda i: i % 5 == 0
    model, counts = brown.fit(docs, F.pmod("doc_id", F.lit(5)) != 0, core=core, classes=6, head=head, least=2)
    got = {r["doc_id"]: r for r in brown.scores(docs, model, counts).collect()}
    c = Counter()
    for i, t, _ in rows:
        if not held(i):
            c.update([*words(t), None])
    n, v = c.total(), len(c)
    assert (model.words.train_tokens, model.words.types) == (n, v)
    of = {w: model.class_of(None if w is None else w.encode()) for t in rows for w in [*words(t[1]), None]}
    tokens, types, pairs = Counter(), Counter(), Counter()
    for w, k in c.items():
        tokens[of[w]] += k
        types[of[w]] += 1
    for i, t, _ in rows:
        if not held(i):
            line = [of[w] for w in [None, *words(t), None]]
            pairs.update(zip(line, line[1:]))
    total = model.end + 1
    table = np.array([[pairs[a, b] for b in range(total)] for a in range(total)], float)
    share = (table.sum(0) + 1) / (table.sum() + total)
    assert np.allclose(10**model.transition, (table + brown.SMOOTH * share) / (table.sum(1, keepdims=True) + brown.SMOOTH))
    for i, t, _ in rows:
        text = [*words(t), None]
        assert got[i]["n_tokens"] == len(text) and got[i]["n_known"] == sum(c[w] > 0 for w in text)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in text), rel=1e-9)
        score, before = 0.0, model.end
        for w in text:
            k = of[w]
            score += model.transition[before, k] + math.log10((c[w] + 1) / (tokens[k] + types[k] + 1))
            before = k
        assert got[i]["score"] == pytest.approx(score, rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(10 ** (-score / len(text)), rel=1e-9)
    assert np.allclose((10**model.transition).sum(1), 1)


def test_exchange_finds_classes_that_alternate():
    rng = random.Random(1)
    left, right = range(0, 10), range(10, 20)
    table = np.zeros((21, 21))
    for _ in range(20_000):
        a, b = rng.choice(left), rng.choice(right)
        table[a, b] += 1
        table[b, rng.choice(left)] += 1
    table[20, 20] = 1
    of = brown.exchange(table, 20, 2, rounds=20)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2


def plain_likelihood(table, of):
    size = of.max() + 1
    n = np.zeros((size, size))
    np.add.at(n, (of[:, None], of[None, :]), table)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(5)
    table = rng.poisson(rng.gamma(0.4, 2, (31, 31))).astype(float)
    of = brown.exchange(table, 28, 4)
    best = plain_likelihood(table, of)
    assert best > plain_likelihood(table, np.concatenate([np.arange(28) % 4, [4, 5, 6]]))
    for w in range(28):
        for k in range(4):
            moved = of.copy()
            moved[w] = k
            assert plain_likelihood(table, moved) <= best + 1e-6


def test_passes_put_words_beside_their_like(spark, monkeypatch):
    """Of a language of two kinds of words in turn, words outside the core join the core's words of their kind, as sums over the corpus say."""
    rng = random.Random(2)
    kinds = [[f"a{i}x" for i in range(60)], [f"b{i}x" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(kinds[i % 2], weights)[0] for i in range(rng.randint(20, 60))) for _ in range(200)]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    model, _ = brown.fit(docs, core=20, classes=2, least=3)
    frequent = [w for w, n in Counter(" ".join(texts).split()).items() if n >= 3]
    got = {w: model.class_of(w.encode()) for w in frequent}
    assert len(frequent) > 60 and {(w[0], k) for w, k in got.items()} in ({("a", 0), ("b", 1)}, {("a", 1), ("b", 0)})
    assert model.head_share > 0.9 and model.passes >= 1
    # Each pass that is kept raises the likelihood of the classes' transitions, as counted anew.
    assert all(b > a for a, b in zip(model.likelihoods, model.likelihoods[1:])) and len(model.likelihoods) == model.passes + 1 == len(model.moved) + 1

    # One pass against plain sums.
    words, counts = brown.vocabulary(docs, least=15)
    rows = brown.encode(docs, words)
    size = len(words.counts)
    lut = np.concatenate([np.arange(size) % 2, 2 + np.arange(brown.BUCKETS)[::-1] // brown.FORMS])
    n = brown._transitions(rows, lut, brown.ENDINGS + 3)
    monkeypatch.setattr(brown, "HELD_CODES", 300)
    monkeypatch.setattr(brown, "HELD_CONTEXTS", 500)
    monkeypatch.setattr(brown, "_MOST", 3)
    movable = np.arange(len(lut)) % 7 > 0
    got = brown._exchange_pass(rows, lut, n, 2, size, movable)
    gain, sums = brown.affinity(n), {}
    for t in texts:
        codes = [int(c) % len(lut) for c in words.codes([w.encode() for w in t.split()])]
        line = [brown.ENDINGS + 2, *(int(lut[p]) for p in codes), brown.ENDINGS + 2]
        for k, p in enumerate(codes, 1):
            sums[p] = sums.get(p, 0) + gain[line[k + 1]] + gain[len(n) + line[k - 1]]
    assert any(p >= size for p in sums)
    expected = lut.copy()
    for p, x in sums.items():
        if movable[p]:
            expected[p] = int(x[:2].argmax()) if p < size else 2 + int(x[2:].argmax())
    assert got.tolist() == expected.tolist()


def test_words_outside_the_head_are_clustered_by_their_form(spark):
    """Of words that occur once, those with the endings of either kind get classes by what stands beside them."""
    rng = random.Random(3)
    texts = []
    for _ in range(200):
        words = []
        for i in range(30):
            stem = "".join(rng.choices("bcdfghjkl", k=6))
            words.append(rng.choice(["the", "some", "this"]) if i % 3 == 0 else stem + rng.choices(["ads", "adt"], [4, 1])[0] if i % 3 == 1 else stem + rng.choices(["egs", "egt"], [1, 4])[0])
        texts.append(" ".join(words))
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    model, _ = brown.fit(docs, core=3, classes=3)
    first = {model.class_of(f"qqqqqq{e}".encode()) for e in ("ads", "adt")}
    second = {model.class_of(f"wwwwww{e}".encode()) for e in ("egs", "egt")}
    # They started in the classes of their last letters.
    assert len(first) == len(second) == 1 and first != second and model.passes >= 1


def test_model_without_training_rows(spark):
    docs = frame(spark, [(1, "a b", None), (2, None, None)])
    model, counts = brown.fit(docs, F.lit(False))
    got = {r["doc_id"]: r for r in brown.scores(docs, model, counts).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["base_score"]) == (3, 0, 0.0) and got[2]["n_tokens"] == 1
    assert math.isfinite(got[1]["score"])
    assert brown.scores(docs.limit(0), model, counts).count() == 0
