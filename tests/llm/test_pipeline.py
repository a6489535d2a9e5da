"""The stages against a plain version of them, on a small folder of tables."""

from collections import Counter

import corpus_pipeline
from tracewell.llm import decontam
from tracewell.llm.linededup import line_key

from .test_operators import DOCS, brute_components, near_copies, sentences


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(9)
    texts = [t for t in near_copies(rng, 4) if t and len(t) < 2000] + [t.upper().replace(" ", "!! ") for t in sentences(rng, 15)]
    item = sentences(rng, 1, 30)[0]
    texts += [f"{t} {item}" for t in sentences(rng, 3)] + [f"The same long line stands in all of these, once each.\n{t}" for t in sentences(rng, 6)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, "r") for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bad = {i for i, t in enumerate(texts) if "!!" in t}
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = {i: t for i, t in enumerate(texts) if i not in bad}
    lines = {i: [line_key(x.encode()) for x in t.split("\n")] for i, t in kept.items()}
    counts = Counter(k for ks in lines.values() for k in set(ks) if len(k) >= 40)
    holder = {k: max(i for i, ks in lines.items() if k in ks) for k, n in counts.items() if n >= 5}
    kept = {i: "\n".join(x for x in t.split("\n") if holder.get(line_key(x.encode()), i) == i) for i, t in kept.items()}
    order = sorted(kept)
    found = brute_components([kept[i] for i in order], 5, 80)
    kept = {i: kept[i] for n, i in enumerate(order) if found[n][1] == n}
    matcher = decontam.Matcher([(1, item)])
    kept = {i: t for i, t in kept.items() if not matcher.search(t)}
    assert set(rows) == set(kept) and all(r.decodes for r in rows.values())
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5
