import collections
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from isovox.llm import packing, quality_rules, surrogates
from isovox.store import written
from tokenizers import Tokenizer

from tests.llm.conftest import DATA, SCHEMA, words
from tests.llm.test_operators import PHONES, components


def passes(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    n, runs = len(w), collections.Counter(zip(w, w[1:], w[2:]))
    hit = len({i + j for i in range(n - 2) if runs[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)})
    capital = sum(sum("A" <= c <= "Z" for c in x) >= 2 and not any("a" <= c <= "z" for c in x) for x in w)
    stop = sum(x.lower() in quality_rules.STOP_WORDS for x in w)
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
    return not (n < 50 or 10 * hit > 3 * n or chars > 20 * n or chars < 2 * n or 10 * symbols > n or 2 * (len(lines) - len(set(lines))) > len(lines) or 2 * capital > n or 50 * stop < sum(bool(re.search('[A-Za-z]', x)) for x in w))


def test_one_number_in_several_documents(spark):
    rows = [(i, f"Call {way} today.", "en", "a", 9) for i, way in enumerate(PHONES)]
    made = corpus_pipeline.personal_data(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()
    assert len(made) == len(rows) and len({"".join(c for c in r["text"] if c.isdigit()) for r in made}) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in made)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, made = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        made.append(docs)
    rules, near, private, mixed, packed = made
    assert all(df.columns == columns for df in made[:4])
    first = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    good = {r["doc_id"]: r["text"] for r in first if passes(r["text"])}
    assert {r["doc_id"]: r["text"] for r in rules.collect()} == good
    rows = sorted(good.items())
    stay = {d for d, _, c in components(rows, 5, 80) if d == c}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(stay)
    hidden = {r["doc_id"]: r for r in private.collect()}
    assert set(hidden) == stay
    for d, r in hidden.items():
        found = surrogates.entities(good[d])
        assert r["n_chars"] == len(r["text"]) and (r["text"] != good[d]) == bool(found) and not any(v in r["text"] for *_, v in found)
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= stay and max(times.values()) <= 2
    size = {d: len(words(r["text"])) for d, r in hidden.items()}
    total = sum(size[d] * n for d, n in times.items())
    assert abs(total / (1.5 * sum(size.values())) - 1) < 0.1
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = sum(n * (len(tokenizer.encode(hidden[d]["text"], add_special_tokens=False).ids) + 1) for d, n in times.items())
    by = packed.toPandas().groupby("sequence_id").length.sum()
    assert by.sum() == want and by.max() <= 2048 and len(by) <= np.ceil(want / 2048) + 1
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, packed.collect()))


def test_odd_tables(spark, odd, none):
    """Nulls, empty and very long texts, repeated rows, ties and clashing columns; and no rows at all."""
    rows = odd.collect()
    made = dict(zip([n for n, _ in corpus_pipeline.STAGES], [stage(spark, odd, DATA) for _, stage in corpus_pipeline.STAGES]))
    assert all(df.columns == odd.columns for n, df in made.items() if n != "pack")
    assert sorted(str(r["doc_id"]) for r in made["quality_rules"].collect()) == sorted(str(r["doc_id"]) for r in rows if passes(r["text"]))
    near = [(r["doc_id"], r["text"]) for r in made["near_dedup"].collect()]
    least = {c for _, n, c in components([(r["doc_id"], r["text"]) for r in rows], 5, 80) if n}
    assert collections.Counter(d for d, t in near if words(t)) == collections.Counter([None, *(c for c in least if c is not None)])
    assert {d for d, t in near if not words(t)} == {r["doc_id"] for r in rows if not words(r["text"])}
    private = {(r["doc_id"], r["text"]): r["n_chars"] for r in made["personal_data"].collect()}
    assert set(private) == {(r["doc_id"], r["text"]) for r in rows} and all(n == (None if t is None else len(t)) for (_, t), n in private.items())
    mixed = collections.Counter((r["doc_id"], r["text"]) for r in made["mix_sources"].collect())
    have = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(words(k[1]) and n <= 2 * have[k] for k, n in mixed.items())
    assert made["pack"].where("start = 0").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
