"""The pipeline and its stages against brute force."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvlake.llm import minhash, mixing, pii, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = ({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


def kept(spark, texts):
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, frame(spark, texts), "").collect())


def changed(rnd, words, n):
    out = list(words)
    for i in rnd.choice(len(out), n, replace=False):
        out[i] = f"new{rnd.integers(10**9)}"
    return out


@pytest.mark.parametrize("cut", [1 << 19, 500])
def test_near_copies_by_similarity(spark, cut, monkeypatch):
    monkeypatch.setattr(minhash, "CUT", cut)
    rnd = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"w{g}x{rnd.integers(400)}" for _ in range(120)]
        texts += [" ".join(changed(rnd, base, k)) for k in (0, 1, 1, 2, 3, 4, 6, 9)]
    texts = list(enumerate([texts[i] for i in rnd.permutation(len(texts))]))
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j, u in texts if jaccard(t, u) >= 0.8) for i, t in texts]
    want = [(i, t) for i, t in texts if root[i] == i]
    fps = [simhash.fingerprint(t.encode()) for _, t in texts]
    assert any((fps[i] ^ fps[root[i]]).bit_count() > simhash.TAU for i, _ in texts)
    assert kept(spark, texts) == want


def test_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    want = sorted([(1, a), (2, b), (2, c), (4, "")])
    for order in (1, -1):
        assert kept(spark, [(1, a), (2, a), (2, b), (2, c), (3, c), (4, ""), (5, None), (2, b)][::order]) == want
    # one of each group stays, one with a doc_id if there is one
    assert kept(spark, [(None, a), (None, a), (1, a)]) == [(1, a)]
    assert sorted(r.text for r in corpus_pipeline.drop_near_copies(spark, frame(spark, [(None, a), (None, a), (None, b)]), "").collect()) == [a, b]
    assert corpus_pipeline.drop_near_copies(spark, frame(spark, []), "").count() == 0


EXTRA = "score double, ids string, size long, whole int, fp string"  # names that the operators use themselves


def write_tables(spark, d, rows, labels):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), .5, "old", 7, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")


def words_of(text):
    return re.findall("[^ \\t-\\r]+", text or "")


def test_whole_pipeline(spark, tmp_path):
    """Rows of every stage by plain Python: decisions of the classifier and surrogates are taken from the operators."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = np.random.default_rng(3)
    pool = ["".join(rnd.choice(list("bcdfglmnprst")) + rnd.choice(list("aeiou")) for _ in range(3)) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(pool, n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, text(int(rnd.integers(8, 90))) + (" you grobnak velkur" if bad else ""), "en", f"s{i % 4}"))
        if i < 200:
            labels.append((i, 1, int(bad)))
    for i in (1, 2, 3, 7):  # near copies, exact copies, and one without id
        words = rows[i][1].split()
        rows += [(300 + i, " ".join([*words[:-1], "changed"]), "en", "s0"), (400 + i, rows[i][1].upper(), "en", None), (None, rows[i][1], "en", "s1")]
    rows += [(500, None, "en", "s0"), (501, "", "en", "s0"), (502, " \n", None, "s9"), (503, "mail jo.doe@x.example.org or call +1 555 555 0100, Mr. John Smith", "en", "s1"), (504, "one <|endoftext|> two", "en", None),
             (505, "long " + "word " * 30_000, "en", "s2"), (506, text(40), "en", "s2"), (506, text(40), "en", "s2"), (None, text(30), None, None), (None, text(31), None, None)]
    labels += [(None, 1, 1), (9, None, None)]
    write_tables(spark, str(tmp_path), rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    scorer = toxicity.Scorer(toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))))
    left = [r for r in rows if scorer.score(r[1]) < .5]
    assert {r[0] for r in rows if r not in left and r[0] is not None and r[0] < 240} == set(range(0, 240, 6))
    got = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r[:2] for r in left)

    root = list(range(len(left)))
    for i, a in enumerate(left):
        for j, b in enumerate(left[:i]):
            if abs(len(a[1] or "") - len(b[1] or "")) < 100 and jaccard(a[1] or "", b[1] or "") >= .8:
                x, y = root[i], root[j]
                root = [min(x, y) if k in (x, y) else k for k in root]
    one = {}
    for r, k in zip(left, root):
        if k not in one or (r[0] is None, r[0] or 0) < (one[k][0] is None, one[k][0] or 0):
            one[k] = r
    left = list(one.values())
    assert len(left) < 235
    surrogate = {r.before: r.text for r in pii.replace(docs.select("text").distinct().withColumn("before", F.col("text"))).collect()}
    left = [(r[0], surrogate[r[1]], *r[2:]) for r in left]
    assert not any("Smith" in (r[1] or "") or "jo.doe" in (r[1] or "") for r in left)

    sizes = Counter()
    for r in left:
        sizes[r[3]] += len(words_of(r[1]))
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight, total, free, target = {n: k % 3 + 1 for k, n in enumerate(names)}, sum(sizes.values()), set(names), {}
    while free:
        level = total / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > 3 * sizes[n]}
        target |= {n: 3 * sizes[n] for n in over} if over else {n: weight[n] * level for n in free}
        total -= sum(target[n] for n in over)
        free = free - over if over else set()
    want = Counter()
    for n in names:
        own = [r for r in left if r[3] == n]
        full, rest = (int(target[n] // sizes[n]), int(target[n])) if sizes[n] else (0, 0)
        rest -= full * sizes[n]
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{mixing.SEED}|{'' if r[0] is None else r[0]}|{len(words_of(r[1]))}".encode()).hexdigest(), r[0] or 0)):
            size = len(words_of(r[1]))
            part = min(size, max(0, rest))
            rest -= part
            if not size:
                want[r[0], r[1]] += 1
                continue
            want[r[0], r[1]] += full + (part == size)
            if 0 < part < size:
                want[r[0], "".join(re.findall("[ \\t-\\r]*[^ \\t-\\r]+", r[1])[:part])] += 1
    want = +want

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter({})
    for (i, t), n in want.items():
        ids[i, tuple(ref.encode(t or "", add_special_tokens=False).ids)] += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == ids


def test_pipeline_on_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    one = tmp_path / "one"
    write_tables(spark, str(one), [(1, "only this text", "en", "s")], [])
    assert [r.n_tokens for r in corpus_pipeline.run(spark, str(one)).collect()] == [3]
