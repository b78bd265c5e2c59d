import hashlib
import math
import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline

INSULTS = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, near copies, a planted passage, nulls and a hot source."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "lmnopqrst"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(14)
    docs, labels = [], []
    for k in range(400):
        body = text(40)
        if toxic := k % 8 == 0:
            body = f"{body} {rng.choice(INSULTS)} {text(5)} {rng.choice(INSULTS)}"
        docs.append((k, body, "en", f"src{k % 3}" if k % 2 else "src0", len(body)))
        labels.append((k, 1, int(toxic)))
    near = docs[1][1].split()
    near[-1] = "changed"
    docs += [(500, docs[1][1], "en", "src1", 0), (501, " ".join(near), "en", "src0", 0), (502, text(10) + ". " + passage.upper() + ", " + text(9), "en", "src2", 0)]
    docs += [(503, passage, "en", "src2", 0), (504, None, None, None, None), (505, "", "en", "src0", 0), (7, *docs[7][1:])]
    at = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, passage


def copies(doc_id, text, rate):
    """Copies of a document by plain inversion."""
    document = str(doc_id) if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
    parts, n = max(1, math.ceil(rate / 16)), 0
    for part in range(1, parts + 1):
        u = int(hashlib.md5(f"mix:{part}:{document}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, math.exp(-rate / parts)
        total = p
        while total <= u and k < 96:
            k += 1
            p *= rate / parts / k
            total += p
        n += k
    return n


def test_stages_one_by_one(spark, folder):
    at, docs, passage = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    table = spark.read.parquet(f"{at}/documents.parquet")

    clean = stages["toxicity"](spark, table, at).cache()
    assert clean.columns == table.columns
    toxic = {d[0] for d in docs if any(w in (d[1] or "") for w in INSULTS)}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d[0] for d in docs if d[0] not in toxic)

    single = stages["near_duplicates"](spark, clean, at).cache()
    assert single.columns == table.columns
    kept = [r.doc_id for r in single.collect()]
    assert sorted(kept) == sorted({r.doc_id for r in clean.collect()} - {500, 501})

    cut = stages["decontamination"](spark, single, at).cache()
    assert cut.columns == table.columns
    texts = {r.doc_id: r for r in cut.collect()}
    assert set(texts) == set(kept) - {503}
    assert passage not in texts[502].text.lower() and len(texts[502].text.split()) == 20 and texts[502].n_chars == len(texts[502].text)
    before = {r.doc_id: tuple(r) for r in single.collect()}
    assert all(tuple(texts[d]) == before[d] for d in texts if d != 502)

    mixed = stages["mixing"](spark, cut, at).cache()
    assert mixed.columns == table.columns
    sizes = Counter()
    for r in texts.values():
        sizes[r.source] += len(r.text or "")
    weights = {s: corpus_pipeline.WEIGHTS.get(s, corpus_pipeline.DEFAULT_WEIGHT) for s, n in sizes.items() if n}
    rates = {s: w / sum(weights.values()) * sum(sizes.values()) / sizes[s] for s, w in weights.items()}
    want = {d: copies(d, r.text, rates.get(r.source, 0.0)) for d, r in texts.items()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in want.items() if n})

    sharded = stages["sharding"](spark, mixed, at).collect()
    assert Counter((r.doc_id, r.text) for r in sharded) == Counter((r.doc_id, r.text) for r in mixed.collect())
    counts = Counter(r.shard for r in sharded)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1

    whole = corpus_pipeline.run(spark, at).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in whole).keys() == Counter((r.doc_id, r.shard, r.slot) for r in sharded).keys()


def test_empty_documents(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    assert docs.count() == 0


def test_entry_registers_every_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
