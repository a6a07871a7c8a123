"""Each operator against plain Python on a small table with nulls, empty, long and repeated texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import bloom, curriculum, langid, linecrf, pieces, resync, shards, simhash, suffixes, weaklabel
from linkloom.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, size string, target string, fp int, a string, b string, id string, row string, `__size` string, `__id` string, `__own` string, n int"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def corpus(n=60, seed=5):
    """Rows with repeated and near texts, blanks, a null, an empty and a long text; clashing extra columns."""
    r = random.Random(seed)
    words = ["lorem", "Ipsum", "dolor", "été", "größer", "a", "it", "the", "x1", "%%"]
    prose = lambda k: " ".join(r.choice(words) + r.choice(["", "", ".", "\n"]) for _ in range(k))
    passage = prose(40)
    out = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, prose(6000)), (5, "aba" * 90), (6, "aba" * 90)]
    for i in range(7, n):
        kind = i % 6
        text = out[-1][1] if kind == 1 else out[-2][1].replace("it", "is", 1) if kind == 2 else prose(r.randint(1, 120)) + (passage if kind == 3 else "")
        out.append((i * 3, text if kind != 4 else text.replace(" ", "  ")))
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 7 == 0 else f"s{i % 3}", "big", "t", 1, "a", "b", "id", "row", "z", "i", "o", 2) for i, t in out]
    return rows + [rows[9], rows[0]]  # the same rows again


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_base_rules_and_labels(docs, empty):
    field = linecrf.LineField.by_hand()
    got = linecrf.quality_rules(docs, field).collect()
    text = dict(plain(docs))
    assert len(got) == docs.count()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        seen, again = set(), 0
        for line in text[r.doc_id].split("\n"):
            again += line in seen and bool(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
            seen.add(line)
        windows = Counter(zip(words, words[1:], words[2:]))
        at = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text[r.doc_id]))
        assert (r.n_dup_lines, r.n_repeat_words) == (again, len(at))
        assert r.base_failed == (len(words) < 50 or 100 * len(at) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert linecrf.quality_rules(empty, field).count() == 0


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(1)
    field = linecrf.LineField(r.normal(size=(linecrf.N_FEATURES, 2)), r.normal(size=(2, 2)))
    for n in range(1, 7):
        lines = [list(r.integers(0, linecrf.N_FEATURES, 3)) for _ in range(n)]
        score = lambda y: sum(field.emit[f, k].sum() for f, k in zip(lines, y, strict=True)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(([int(x) for x in f"{k:0{n}b}"] for k in range(1 << n)), key=score)
        assert score(field.decode(lines)) == pytest.approx(score(best))
    assert field.decode([]) == []


def test_posteriors_are_those_of_all_labellings():
    """Unary posteriors, expected moves and partition sums against the sum over all labellings."""
    r = np.random.default_rng(2)
    texts = [[list(r.choice(linecrf.N_FEATURES, 3, replace=False)) for _ in range(n)] for n in (3, 1, 5)]
    emit, move = r.normal(size=(linecrf.N_FEATURES, 2)), r.normal(size=(2, 2))
    lines = linecrf.Lines(texts)
    p, moves, norm = lines.posteriors(lines.matrix @ emit, move)
    want_p, want_moves = np.zeros_like(p), np.zeros((2, 2))
    for t, at in zip(texts, lines.start, strict=True):
        n, total, own_p, own_moves = len(t), 0.0, np.zeros((len(t), 2)), np.zeros((2, 2))
        for k in range(1 << n):
            y = [k >> j & 1 for j in range(n)]
            w = np.exp(sum(emit[f, v].sum() for f, v in zip(t, y, strict=True)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            own_p[np.arange(n), y] += w
            for a, b in zip(y, y[1:], strict=False):
                own_moves[a, b] += w
        want_p[at : at + n], want_moves = own_p / total, want_moves + own_moves / total
        assert norm[at : at + n] == pytest.approx(np.log(total))
    assert p == pytest.approx(want_p) and moves == pytest.approx(want_moves)
    words, good = np.ones(len(p)), np.array([True, False, True])
    held = lines.constrained(lines.matrix @ emit, move, words, good)
    assert lines.moves(np.array([0, 1, 1, 0, 1, 1, 0, 0, 1])).tolist() == [[1, 2], [1, 2]]
    share = np.bincount(lines.text, held[:, linecrf.CONTENT]) / np.bincount(lines.text)
    assert (share[good] >= linecrf.GOOD_SHARE - 1e-9).all() and (share[~good] <= linecrf.BAD_SHARE + 1e-9).all()


def test_fitted_field_tells_lines_apart(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    field = linecrf.fit_field(d, labels)
    got = linecrf.quality_rules(d, field).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    assert np.mean(good) > 0.95
    assert not any(r.kept for r in got if r.quality == 0 and r.n_repeat_words > r.n_words / 2)
    # Lines planted among prose: the field was trained on labels of documents only.
    r, right, n = random.Random(8), 0, 0
    prose = [x.strip().encode() for row in d.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").limit(60).collect() for x in (row.text or "").split("\n") if len(x.split()) > 5]
    junk = [lambda w: " | ".join(w), lambda w: " ".join(x.upper() + "!!" for x in w), lambda w: " ".join(x + r.choice(["%%%", "&&&", "$$$"]) for x in w)]
    for _ in range(60):
        lines, truth = [], []
        for _ in range(r.randint(2, 4)):  # blocks of one kind, as menus and notices stand in pages
            kind = r.choice([None, *junk])
            for _ in range(r.randint(2, 4)):
                x = r.choice(prose)
                lines.append(x if kind is None else kind(x.decode().split()).encode())
                truth.append(int(kind is None))
        marks = field.decode(linecrf.line_features(b"\n".join(lines))[0])
        right += sum(a == b for a, b in zip(marks, truth, strict=True))
        n += len(truth)
    assert right > 0.9 * n
    assert linecrf.fit_field(d, labels.limit(0)).emit.tolist() == linecrf.LineField.by_hand().emit.tolist()
    # Of conflicting labels the worse counts, whatever the order of rows.
    twice = labels.unionByName(labels.withColumn("quality", F.lit(0))).orderBy(F.rand(1))
    assert {r.quality for r in linecrf.labelled_sample(d, twice, 50).collect()} == {0}


def test_kneser_ney_sums_to_one_and_identifies(spark, sf_dir, docs, empty):
    keys, n = np.unique(np.concatenate([langid.grams(langid.codes(t)) for t in ("a cat sat on a mat", "a dog")]), return_counts=True)
    model = langid.Model(keys, n)
    seen = np.unique(keys & np.uint64(0xFFFF))
    for context in np.unique(keys >> np.uint64(16))[:8]:
        p = model.probability((context << np.uint64(16)) | seen).sum()
        assert 0.9 < p <= 1.0 + 1e-9
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trained = langid.train(d.filter("doc_id % 4 <> 2").select("lang", "text"))
    got = langid.identified(d.filter("doc_id % 4 = 2"), trained).join(d, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    odd = {r.doc_id: r for r in langid.identified(docs, trained).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identified(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identified(docs, langid.train(empty)).collect()} == {"und"}
    # Scripts above U+FFFF keep their letters apart, from each other and from other scripts.
    adlam, osage = (("".join(chr(a + k) for k in ks)) for a, ks in ((0x1E922, (0, 5, 9, 3)), (0x104D8, (0, 7, 2, 8))))
    assert len(set(langid.codes(adlam).tolist()) | set(langid.codes(osage).tolist())) == 8
    wide = spark.createDataFrame([("ff", f"{adlam} {adlam[::-1]}"), ("osa", f"{osage} {osage[::-1]}")], "lang string, text string")
    both = spark.createDataFrame([(1, adlam), (2, osage)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identified(both, langid.train(wide)).collect()} == {1: "ff", 2: "osa"}
    # Models in slices, held one after the other, say what whole models say.
    parts = langid.train(d.filter("doc_id % 4 <> 2").select("lang", "text"), trained.grams.count() // 4)
    assert trained.slices == 1 and parts.slices == 5 and trained.grams.count() == sum(len(m.orders[-1][0]) for k in range(5) for m in parts.part(k).models)
    every = d.select("doc_id", "text").unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    key = lambda r: (r.doc_id, r.lang_pred, r.rejected, round(r.score, 4), r.cross_entropy and round(r.cross_entropy, 4))
    assert Counter(map(key, langid.identified(every, parts).collect())) == Counter(map(key, langid.identified(every, trained).collect()))


def test_exact_groups(docs, empty, monkeypatch):
    rows = [(i, BLANK.sub(" ", t)) for i, t in plain(docs)]
    for slice_bits in (28, 19):  # one filter, then two slices
        monkeypatch.setattr(bloom, "SLICE_BITS", slice_bits)
        got = bloom.exact_groups(docs).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, min(j for j, u in rows if u == t), sum(u == t for _, u in rows), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        assert sum(r.kept for r in got) == len({t for _, t in rows})
    left = bloom.exact_copies_dropped(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert bloom.exact_groups(empty).count() == 0 and bloom.exact_copies_dropped(empty).count() == 0


def test_pieces_round_trip_and_spans(docs, empty):
    path = pieces.model_path()
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {i: t for i, t in plain(docs)}
    for r in pieces.encoded(docs, path).collect():
        t = text[r.doc_id]
        assert r.ids == p.encode(t, add_bos=True, add_eos=True) and r.decoded == p.decode(r.ids) and r.n_tokens == len(r.ids)
        raw = t.encode()
        for k, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            piece = p.id_to_piece(k).replace("▁", " ")
            if not (p.is_byte(k) or p.is_control(k)):
                assert raw[a:b].decode() in (piece, piece[1:])
    for r in pieces.coded(docs, path).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.covered == len(text[r.doc_id].encode())
    assert pieces.encoded(empty, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aé éﬁ①ｱﾞ㍿Å 　\tΣ½ab字😀"), max_size=30))
def test_compiled_map_normalises_like_the_library(text):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    own = pieces.Normaliser(library.serialized_model_proto())
    out, start, end = own(text.encode())
    assert out.decode() == library.normalize(text)
    assert len(start) == len(end) == len(out) and (np.diff(start) >= 0).all() and (end >= start).all()


def test_token_counts(docs, empty):
    path = resync.model_path()
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    text = dict(plain(docs))
    for r in resync.token_counts(docs, path, limit=100).collect():
        n = len(p.encode(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 100)
    assert resync.token_counts(empty, path).count() == 0
    small = resync.Counter(path, chunk=24, overlap=4)
    r = random.Random(3)
    for _ in range(150):
        t = "".join(r.choice("aabé \n字😀▁<s>12\0" + "th e") for _ in range(r.randint(0, 300)))
        assert small.count(t) == len(p.encode(t))
    assert small.count("a" * 500) == len(p.encode("a" * 500)) and small.widened > 0


def _simhash(text, n=4):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def _least(ids, linked):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize(("threshold", "homes"), [(4, 4096), (4, 2), (7, 4096)])
def test_simhash_components(docs, empty, threshold, homes, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES_PER_TASK", homes)
    text = dict(plain(docs))
    fp = {i: _simhash(t) for i, t in text.items()}
    least = _least(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= threshold])
    got = simhash.simhash_components(docs, threshold=threshold).collect()
    assert len(got) == docs.count()
    assert all((r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", least[r.doc_id]) for r in got)
    assert simhash.simhash_components(empty).count() == 0
    left = simhash.near_copies_dropped(docs)
    assert left.columns == docs.columns and left.count() < docs.count()


def test_anchor_cover_misses_no_pair(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    values = list(dict.fromkeys(base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 6))) for b in base for _ in range(6)]))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v, v, 0) for v in signed], "node bigint, fp bigint, second bigint")
    got = {x.node: x.root for x in simhash.components(simhash.near_edges(nodes, 4)).collect()}
    want = _least(signed, [(a, b) for a, x in zip(signed, values, strict=True) for b, y in zip(signed, values, strict=True) if a < b and (x ^ y).bit_count() <= 4])
    assert all(got.get(v, v) == want[v] for v in signed)


def test_shards(docs, empty):
    got = shards.sharded(docs).collect()
    text = Counter(plain(docs))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in text.elements())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    again = shards.sharded(docs).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in again)
    assert shards.sharded(empty).count() == 0


def test_shards_hot_group(spark):
    rows = [(i, "same" if i % 3 == 0 else f"own {i}" if i % 5 else f"pair {i // 10}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = shards.sharded(d)
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {75}
    cut = shards.cut_links(out, d).first()
    assert cut["cut"] < 0.75 * cut["links"]


def test_weak_labels(spark, sf_dir, docs, empty):
    r = np.random.default_rng(0)
    truth = r.random(6000) < 0.2
    votes = np.stack([np.where(r.random(6000) < c, np.where(r.random(6000) < a, 1 + truth, 2 - truth), 0) for c, a in ((0.9, 0.9), (0.8, 0.8), (0.5, 0.98))], axis=1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, theta, prior = weaklabel.em(patterns, counts.astype(float))
    assert np.mean((post[back.ravel()] > 0.5) == truth) > 0.93 and prior == pytest.approx(0.2, abs=0.05)
    assert theta[0, 1, 2] / theta[0, 1, 1:].sum() == pytest.approx(0.9, abs=0.08)
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scorer = weaklabel.fit(d, labels.filter("doc_id % 3 > 0"))
    got = weaklabel.scored(d, scorer).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = [(r.p_bad >= 0.5) == (r.quality == 0 or r.toxic == 1) for r in got]
    assert np.mean(right) > 0.8
    assert weaklabel.scored(docs, scorer).count() == docs.count() and weaklabel.scored(empty, scorer).count() == 0
    none = weaklabel.fit(empty, labels.limit(0))
    assert weaklabel.scored(docs, none).filter("p_bad > 0.5").count() == 0


def placed(docs):
    return curriculum.placed(docs.select(F.col("doc_id").alias("id"), "source", curriculum.word_count().alias("size")))


def test_mixture(docs, empty, spark):
    got = placed(docs).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in plain(docs)}
    assert len(got) == docs.count() and all(r["size"] == words[r.id] for r in got)
    names = sorted({r.source for r in got if r.source}) + [None]
    total = {s: sum(r["size"] for r in got if r.source == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(total.values())
    while free:
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in over} if over else level
        rest -= sum(3 * total[s] for s in over)
        free = free - over if over else set()
    for s in names:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(target[s])
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - target[s]) <= max(r["size"] for r in own) and all(r["copies"] <= 3 for r in own)
        assert all(0 <= r["position"] <= 1 for r in own if r["copies"])
    mix = curriculum.mixture(docs, curriculum.word_count())
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in got)
    assert placed(empty).count() == 0 and curriculum.mixture(empty, curriculum.word_count()).count() == 0
    plan = placed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
    # Without repeated ids the rows are looked up; the mixture is the same, also in its order.
    once = docs.dropDuplicates(["doc_id"]).cache()
    first = [r.doc_id for r in curriculum.mixture(once, curriculum.word_count()).collect()]
    more = once.unionByName(once.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit("")))
    assert [r.doc_id for r in curriculum.mixture(more, curriculum.word_count()).collect() if r.doc_id is not None] == first


def _fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_language_query_holds_out_its_fold(spark, sf_dir):
    """held_out by crc32 of the id, and probabilities by the definition of Kneser-Ney, by counting, of the other folds' texts."""
    d = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = langid.op2_kneser_ney_language(spark, sf_dir).collect()
    assert len(got) == len(d) and all(r.held_out == (_fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == d[r.doc_id].lang for r in got if r.held_out and d[r.doc_id].lang and r.lang_pred != "und"]) > 0.9
    counts = {}
    for i, r in d.items():
        if _fold(i) != 2 and r.lang and r.text:
            x = [32] * 3 + langid.codes(r.text).tolist() + [32] if len(langid.codes(r.text)) else []
            for k in range(3, len(x)):
                key = tuple(x[k - 3 : k + 1])
                counts.setdefault(r.lang, Counter())[key] += 1

    def tables(four):
        out = {4: dict(four)}
        for n in (3, 2, 1):
            out[n] = Counter(k[1:] for k in out[n + 1])
        return out

    models = {lang: tables(c) for lang, c in counts.items()}
    sums = {lang: {n: {} for n in t} for lang, t in models.items()}
    for lang, t in models.items():
        for n, c in t.items():
            for k, v in c.items():
                total, kinds = sums[lang][n].get(k[:-1], (0, 0))
                sums[lang][n][k[:-1]] = total + v, kinds + 1

    def p(lang, key):
        value = 1.0 / (len(models[lang][1]) + 1)
        for n in (1, 2, 3, 4):
            k = key[4 - n :]
            if k[:-1] in sums[lang][n]:
                total, kinds = sums[lang][n][k[:-1]]
                value = max(models[lang][n].get(k, 0) - 0.75, 0) / total + 0.75 * kinds / total * value
        return value

    for r in sorted(got, key=lambda r: r.doc_id)[:25]:
        if r.cross_entropy is not None:
            x = [32] * 3 + langid.codes(d[r.doc_id].text).tolist() + [32]
            keys = [tuple(x[k - 3 : k + 1]) for k in range(3, len(x))]
            h = {lang: -np.mean([np.log(p(lang, k)) for k in keys]) for lang in models}
            assert r.lang_pred == min(sorted(h), key=h.get) and r.cross_entropy == pytest.approx(h[r.lang_pred], abs=1e-4)


def _removed(rows):
    seen, out = {}, {}
    for i, t in sorted(set(rows)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            else:
                seen[b[k : k + 100]] = i
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize(("hot", "piece"), [(8192, 1 << 20), (2, 1 << 20), (8192, 150)])
def test_repeated_strings_go(docs, empty, hot, piece, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    want = _removed([(i, t) for i, t in plain(docs)])
    got = suffixes.removals(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.n_spans == len(r.starts) == len(r.ends)
    assert suffixes.removals(empty).count() == 0


def test_difference_cover_and_suffix_order():
    for period in (4, 7, 32, 73):
        c = suffixes.difference_cover(period)
        assert {(a - b) % period for a in c for b in c} == set(range(period))
    r = np.random.default_rng(4)
    data = r.integers(97, 99, 900).astype(np.uint8)
    data[300:500] = data[0:200]
    data = np.concatenate([data, np.zeros(200, np.uint8)])
    at = np.arange(0, 800, 32)
    order = suffixes.sorted_suffixes(data, at, np.zeros(len(at), np.int64))
    raw = data.tobytes()
    assert [raw[at[k] : at[k] + 100] for k in order] == sorted(raw[a : a + 100] for a in at)


def _tables(spark, docs, at):
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    rows = [(r.doc_id, int(r.doc_id % 3 > 0), 0) for r in docs.select("doc_id").distinct().collect()]
    spark.createDataFrame(rows + [(r[0], 0, 1) for r in rows[:3]], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_queries_against_brute_force(spark, docs, empty, tmp_path):
    """Every registered query on a table with nulls, empty, long and repeated texts, ties and clashing columns, and on an empty one."""
    at, none = _tables(spark, docs, tmp_path / "some"), _tables(spark, empty, tmp_path / "none")
    got = {name: f(spark, at).collect() for name, f in QUERIES.items()}
    for name, f in QUERIES.items():
        assert f(spark, none).count() == 0, name
    n, text = docs.count(), dict(plain(docs))
    assert all(Counter(r.doc_id for r in rows) == Counter(i for i, _ in plain(docs)) and len(rows) == n for rows in got.values())
    p = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    of = lambda op: next(rows for name, rows in got.items() if name.startswith(f"op{op}_"))
    for r in of(1):
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words))) and not (r.base_failed and r.kept)
    for r in of(4):
        ids = p.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(p.decode(ids).encode()).hexdigest()
    for r in of(5):
        k = len(p.encode(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), k, k > 4096)
    fp = {i: _simhash(t) for i, t in text.items()}
    least = _least(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert all((r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", least[r.doc_id]) for r in of(6))
    for r in of(7):
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    by = Counter(r.shard for r in of(7))
    assert max(by.values()) - min(by.values()) <= 1 and all(sorted(r.slot for r in of(7) if r.shard == s) == list(range(k)) for s, k in by.items())
    assert all(r.score == pytest.approx(1 - r.p_bad) and r.kept == (r.p_bad < 0.5) for r in of(8))
    gone = _removed(plain(docs))
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == gone[r.doc_id] for r in of(10))


def test_votes_and_features(spark):
    """Votes of each labeller on texts made for it, below and above the old limit of 2,000 words; hashed features by their definition."""
    vote = lambda t, k: weaklabel.junk_votes(weaklabel.style(t))[weaklabel.JUNK.index(k)]
    for n in (60, 1999, 2000, 6000):
        loop = b" ".join([b"one", b"two", b"three", b"four"][i % 4] for i in range(n))
        assert vote(loop, "variety") == weaklabel.BAD and vote(loop, "repeats") == weaklabel.BAD
        prose = " ".join(f"w{i % 900}x{i * i % 700}" for i in range(n)).encode()
        assert vote(prose, "variety") == weaklabel.ABSTAIN and vote(prose, "prose") == weaklabel.GOOD
    assert vote(b"A!! LOUD!! TEXT!!", "upper") == vote(b"A!! LOUD!! TEXT!!", "bangs") == weaklabel.BAD
    assert vote(b"a | b | c | d", "pipes") == weaklabel.BAD and vote(b"a$$ b%% c##", "symbols") == weaklabel.BAD
    assert vote(b"so so so so", "beside") == weaklabel.BAD and set(weaklabel.junk_votes(weaklabel.style(b""))) == {weaklabel.ABSTAIN}
    lexicon = weaklabel.Lexicon((frozenset([b"vile"]), frozenset()), (frozenset(), frozenset([b"hate"])))
    words = weaklabel.words_of(b"Vile, hateful idiot")
    assert words == {b"vile", b"hateful", b"idiot"} and lexicon.hits(words, weaklabel.stems(words)) == 2
    assert lexicon.votes(words, weaklabel.stems(words)) == [weaklabel.BAD, weaklabel.BAD, weaklabel.ABSTAIN, weaklabel.ABSTAIN, weaklabel.BAD]
    size = (1 << weaklabel.HASH_BITS) - 2
    own = {1, *(2 + zlib.crc32(w) % size for w in (b"calm", b"text")), 2 + zlib.crc32(b"variety>0.6", weaklabel.OF_NAME) % size, 2 + zlib.crc32(b"variety>0.4", weaklabel.OF_NAME) % size, 2 + zlib.crc32(b"variety>0.2", weaklabel.OF_NAME) % size}
    own |= {2 + zlib.crc32(f"letters>{x}".encode(), weaklabel.OF_NAME) % size for x in (0.5, 0.7)}
    assert set(weaklabel.hashed(b"calm text", weaklabel.Lexicon()).tolist()) == own
