"""Kneser-Ney models against a dictionary version; quality classifier and language identification on odd rows and held-out text."""

import math
from collections import Counter, defaultdict

import pytest

from tidalframe.llm.kneser_ney import estimate, score_grams
from tidalframe.llm.language_id import train
from tidalframe.llm.quality import PRIOR_UNITS, QUANTILE, ROOM, STEPS, quality_classifier
from tidalframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def text_units(text, order=3):
    raw = (text or "").encode("utf-16-le")
    return [2] * (order - 1) + [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def text_grams(text, order=3):
    u = text_units(text, order)
    return [tuple(u[i : i + order]) for i in range(len(u) - order + 1)]


class PlainModel:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, counts, order=3):
        self.order, self.level = order, {order: dict(counts)}
        for k in range(order - 1, 0, -1):
            self.level[k] = Counter(g[1:] for g in self.level[k + 1])
        self.total, self.mass, self.less = defaultdict(int), defaultdict(float), {}
        for k, level in self.level.items():
            n = [sum(v == i for v in level.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
            d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else g for i, g in ((1, 0.5), (2, 1.0), (3, 1.5))]
            self.less[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
            for g, v in level.items():
                self.total[g[:-1]] += v
                self.mass[g[:-1]] += self.less[k][min(v, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / 65536
        context, v = g[:-1], self.level[len(g)].get(g, 0)
        if not self.total[context]:
            return self.p(g[1:])
        own = v - self.less[len(g)][min(v, 3) - 1] if v else 0.0
        return own / self.total[context] + self.mass[context] / self.total[context] * self.p(g[1:])


def packed(g):
    out = 0
    for c in g:
        out = out << 16 | c
    return out


def test_estimates_equal_dictionaries(spark):
    texts = ["the cat sat on the mat", "a cat and a hat", "the 😀 mat", "zzz", ""]
    counts = Counter(g for t in texts for g in text_grams(t))
    model = PlainModel(counts)
    frame = spark.createDataFrame([("m", packed(g), n) for g, n in counts.items()], "model string, gram bigint, n bigint")
    wanted = {packed(g): g for t in [*texts, "unseen catx é"] for g in text_grams(t)}
    probabilities, gammas = estimate(frame, 3, "t")
    got = score_grams(spark.createDataFrame([("m", k) for k in wanted], "model string, gram bigint"), probabilities, gammas, 3).collect()
    assert {r.gram for r in got} == set(wanted) and len(got) == len(wanted)
    assert all(abs(r.logp - math.log(model.p(wanted[r.gram]))) < 1e-9 for r in got)
    # all units after a known context sum to one, but for what the empty context leaves to unseen ones
    seen = [g[0] for g in model.level[1]]
    assert abs(sum(model.p((2, ord("t"), c)) for c in seen) + (65536 - len(seen)) * model.p((2, ord("t"), 5)) - 1) < 1e-9


def plain_quality(rows, trusted):
    """(id, lang, text) rows to (id, perplexity, limit, keep)."""
    good = [i is not None and i in trusted for i, _, _ in rows]
    model = PlainModel(Counter(g for (_, _, t), y in zip(rows, good) if y for g in text_grams(t)))
    scored = [(-sum(math.log(model.p(g)) for g in text_grams(t)), len(text_grams(t))) for _, _, t in rows]
    nats, n, by = defaultdict(float), defaultdict(int), defaultdict(list)
    for (_, lang, _), y, (s, k) in zip(rows, good, scored):
        if y and k:
            nats[lang] += s
            n[lang] += k
    mean = {lang: nats[lang] / n[lang] for lang in n}
    whole = sum(nats.values()) / max(1, sum(n.values()))
    entropy = [(s + PRIOR_UNITS * mean.get(r[1], whole)) / (k + PRIOR_UNITS) for r, (s, k) in zip(rows, scored)]
    for r, y, e, (_, k) in zip(rows, good, entropy, scored):
        if y and k:
            by[r[1]].append(math.ceil(e * STEPS))
    reach = lambda steps: sorted(steps)[max(0, math.ceil(QUANTILE * len(steps) - 1e-9) - 1)]
    limit = {lang: math.exp(reach(s) / STEPS) * ROOM for lang, s in by.items()}
    pooled = math.exp(reach([x for s in by.values() for x in s]) / STEPS) * ROOM
    return [(r[0], math.exp(e), limit.get(r[1], pooled), math.exp(e) <= limit.get(r[1], pooled)) for r, e in zip(rows, entropy)]


def test_quality_equals_dictionaries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    want = {w[0]: w[1:] for w in plain_quality([(r.doc_id, r.lang, r.text) for r in docs], {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0})}
    got = {r.doc_id: (r.perplexity, r.perplexity_limit, r.keep) for r in QUERIES["op3_quality_classifier"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert all(g[2] == want[i][2] and g[:2] == pytest.approx(want[i][:2], rel=1e-5) for i, g in got.items())
    bad = [got[r.doc_id][2] for r in labels if r.quality == 0]
    good = [got[r.doc_id][2] for r in labels if r.quality == 1]
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.95 * len(good)


def test_quality_defined_results(spark):
    rows = [(1, "en", "plain words stand here in a row " * 5), (2, "en", "plain words in a row here " * 5), (3, None, None), (4, "xx", ""), (5, "en", "@@#$%^&*!!" * 30), (None, "en", "words"), (1, "en", "plain"), (6, "en", "w " * 60000)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").selectExpr("*", "'k' AS keep", "1 AS block", "2 AS row", "array(1) AS trusted")
    trusted = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id bigint")
    model = quality_classifier(df, trusted)
    out = model.rows()
    assert out.columns == ["doc_id", "lang", "text", "block", "row", "trusted", "perplexity", "perplexity_limit", "keep"]
    decided = {(r.doc_id, r.text): r.keep for r in out.collect()}
    want = plain_quality(rows, {1, 2, 99})
    assert decided == {(i, t): w[3] for (i, _, t), w in zip(rows, want)}
    assert decided[5, rows[4][2]] is False and decided[3, None] and decided[4, ""]
    kept = model.kept()
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if decided[r.doc_id, r.text])
    assert quality_classifier(df, trusted.where("false")).kept().count() == len(rows)
    nothing = quality_classifier(df.where("false"), trusted)
    assert nothing.rows().count() == 0 and nothing.kept().count() == 0


def test_language_query_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_defined_results(spark):
    en, de = "the house and the other words of this text ", "das haus und die anderen wörter dieses textes "
    rows = [(i, en * (1 + i % 4), "en") for i in range(20)] + [(i, de * (1 + i % 4), "de") for i in range(20, 40)]
    df = spark.createDataFrame(rows + [(41, None, "en"), (42, "12 34 !!", "en"), (43, en, None), (44, "", "de")], "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS score", "1 AS model", "2 AS n")
    model = train(df)
    tests = spark.createDataFrame([(1, en), (2, de * 3000), (3, None), (4, ""), (5, "1234 ... !"), (6, "Ж ж ж длинный текст"), (None, "the"), (1, en)], "doc_id bigint, text string").selectExpr("*", "'z' AS lang_pred", "array('q') AS entropy")
    out = model.predict(tests)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "entropy", "accepted"]
    got = {(r.doc_id, (r.text or "")[:9]): r for r in out.collect()}
    assert out.count() == 8
    assert [got[1, en[:9]].lang_pred, got[2, de[:9]].lang_pred, got[None, "the"].lang_pred] == ["en", "de", "en"]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].accepted for k in ((3, ""), (4, ""), (5, "1234 ... ")))
    assert not got[6, "Ж ж ж дли"].accepted and got[6, "Ж ж ж дли"].lang_pred in ("en", "de") and got[1, en[:9]].accepted
    untaught = train(df.where("false")).predict(tests)
    assert {r.lang_pred for r in untaught.collect()} == {"und"} and model.predict(tests.where("false")).count() == 0


def plain_entropies(rows, texts):
    """Languages, and for every text its cross-entropy in each, by dictionaries."""
    names = sorted({lang for _, lang in rows})
    models = [PlainModel(Counter(g for t, lang in rows if lang == name for g in text_grams(t.lower()))) for name in names]
    return names, [[-sum(math.log(m.p(g)) for g in text_grams(t.lower())) / len(text_grams(t)) for m in models] for t in texts]


def test_language_models_equal_dictionaries(spark):
    """All grams are kept and looked up exactly, in arrays and in tables, also many rare ones that a hash table would mix up."""
    rare = ["".join(chr(0x4E00 + (i * 37 + j * j * 101 + k * 7919) % 20000) for j in range(400)) for k, i in enumerate(range(60))]
    rows = [("The house and the other words " * 3, "en"), ("and this is a text", "en"), ("das haus und die wörter", "de"), ("ein 😀 text", "de")]
    rows += [(t, "zh" if i % 2 else "ja") for i, t in enumerate(rare)]
    texts = ["the text", "das wort", "Über", rare[3], rare[4][::-1], rare[7][:50] + "and the", "zzz", "😀 a"]
    names, want = plain_entropies(rows, texts)
    df = spark.createDataFrame(rows, "text string, lang string")
    asked = spark.createDataFrame(list(enumerate(texts)), "text_no long, text string").selectExpr("*", "'own' AS `row`", "1 AS letters", "2 AS _text")
    for limit in (1 << 30, 0):
        model = train(df, model_bytes=limit)
        assert type(model.models).__name__ == ("CharacterModels" if limit else "ShardedModels") and model.models.languages == names
        out = model.predict(asked)
        assert out.columns == [*asked.columns, "lang_pred", "score", "entropy", "accepted"]
        got = {r.text_no: r for r in out.collect()}
        for i, entropies in enumerate(want):
            assert got[i].lang_pred == names[entropies.index(min(entropies))] and got[i].row == "own" and got[i]._text == 2
            assert got[i].entropy == pytest.approx(min(entropies), rel=1e-4)


def test_language_limits_come_from_all_texts(spark):
    """Each of these texts is far from the others, so each of them sets the limit; none may be left out of the calibration."""
    plain = [("the house and the other words of this text %d" % (i % 7), "en") for i in range(60)]
    for k in range(2):
        far = "".join(chr(0x4E00 + (k * 997 + j * j * 31) % 20000) for j in range(60))
        model = train(spark.createDataFrame([*plain, (far, "en")], "text string, lang string"))
        assert model.limits["en"] > 10
