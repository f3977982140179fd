import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_decontaminate
import test_mixing
import test_near_dedup

from kindred.llm import quality
from kindred.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], SF), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames[-1].dtypes == docs.dtypes
    before, rated, unique, clean, mix = ([tuple(r) for r in f.collect()] for f in frames[:5])
    good = [r for r in before if model.score(*quality.features((r[1] or "").encode(), r[4], model.bits)) >= 0.3]
    assert Counter(rated) == Counter(good) and len(rated) < len(before)

    # SimHash candidates miss a pair now and then; what is not similar is never dropped.
    first = Counter(test_near_dedup.brute_kept(rated))
    assert not first - Counter(unique) and len(first) < len(rated)
    assert len(rated) - len(unique) >= 0.9 * (len(rated) - sum(first.values()))

    bad = {d for d, _ in test_decontaminate.brute([r[:2] for r in unique], bench)}
    assert Counter(clean) == Counter(r for r in unique if r[0] not in bad)

    # A source of a few documents comes no nearer than half of its longest.
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in clean:
        sizes[r[3]] += len(r[1].split())
        longest[r[3]] = max(longest[r[3]], len(r[1].split()))
    for r in mix:
        taken[r[3]] += len(r[1].split())
    for s, want in test_mixing.brute_targets(sizes).items():
        assert abs(taken[s] - want) <= max(0.01 * want, longest[s] / 2 + 1)
    assert max(Counter(mix).values()) <= 3 and set(mix) <= set(clean)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*library.encode(r[1], add_special_tokens=False).ids, 0] for r in clean}
    start = 0
    for row in sorted(frames[5].collect(), key=lambda r: r.start):
        own = ids[row.doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert frames[5].count() == len(mix)
