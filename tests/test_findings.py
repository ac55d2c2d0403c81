"""Results on values that the small tables don't hold, against the queries' SQL or by hand."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import kernels, ledger, providers, transcript
from lectern.plans import catalog, scanning
from lectern.sources import pdf
from tests.test_oracle import compare


def stored(folder, **tables):
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(folder / f"{name}.parquet", index=False)
    return str(folder)


def same_as_sql(spark, folder, name, **tables):
    compare(spark, stored(folder, **tables), catalog.QUERIES[name], catalog.ORACLE[name])


def test_rounded_border_keeps_the_sign_of_zero(spark, tmp_path):
    image = np.full(64, 0.25, np.float32)
    image[[0, 1, 2, 9]] = [-1e-7, -0.0, 1e-7, -1e-7]
    same_as_sql(spark, tmp_path, "convolve3x3", embeddings={"vec_id": [1, 2], "embedding": [list(image), list(-image)]})
    x = spark.createDataFrame([(-1e-7,), (-0.0,), (0.0,), (-0.0000015,), (float("nan"),), (None,)], "x double")
    assert [repr(r.y) for r in x.select(kernels.signed_round(F.col("x"), 6).alias("y")).collect()] == ["-0.0", "-0.0", "0.0", "-2e-06", "nan", "None"]


def test_noise_as_in_sql_beside_letters_that_are_not_ascii(spark, tmp_path):
    texts = ["loñadas erm, ñlo x", "lo\u00e9 \u00e9lah? likelike like like", "la\u017f \u017fo so sia\u017f siA, o\u212aay? Hmm\u0301 erm\u00a0x", "a\x0bb \u2003 c\u00a0 \u0085 d\x1c e \x0b", " you KNOW? yOu know", "", None]
    same_as_sql(spark, tmp_path, "noise_removal", conversations={"conv_id": [1] * len(texts), "turn": range(len(texts)), "role": ["user"] * len(texts), "text": texts})
    kept = spark.createDataFrame([("lo\u00f1adas lo\u00a0x",)], "t string").select(transcript.without_noise(F.col("t")).alias("t")).first()
    assert kept.t == "lo\u00f1adas x"


def test_vectors_are_units_where_words_cancel_out(spark, tmp_path):
    place = lambda w: (lambda h: (int.from_bytes(h[:4], "little") % 64, h[4] % 2))(hashlib.blake2b(w.encode(), digest_size=8).digest())
    seen, pair = {}, None
    for k in range(10_000):
        at, sign = place(f"w{k}")
        if (at, 1 - sign) in seen:
            pair = f"{seen[at, 1 - sign]} w{k}"
            break
        seen[at, sign] = f"w{k}"
    texts = ["", pair, " ", "a b c", f"{pair} {pair}"]
    same_as_sql(spark, tmp_path, "seed_embeddings", documents={"doc_id": range(1, 6), "text": texts, "source": ["s"] * 5})


def test_pdf_files_as_rows_of_a_table(spark):
    made = {2: scanning._drawn(2, ["a (b)", "c d"] * 300), 1: scanning._drawn(1, []), 0: scanning._drawn(0, []), 3: b"", 4: None}
    files = spark.createDataFrame([(f"{k}.pdf", None if v is None else bytearray(v)) for k, v in made.items()], "path string, content binary").coalesce(1)
    found = pdf.pages_of(files)
    spans = pdf.spans(found)
    assert {r.path: r.error for r in pdf.failures(found, spans).collect()} == {"0.pdf": "an object has no end", "1.pdf": "no text", "3.pdf": "not a PDF", "4.pdf": "not a PDF"}
    assert [(r.page, r.n, r.most) for r in spans.groupBy("page").agg(F.count("*").alias("n"), F.max("line").alias("most")).orderBy("page").collect()] == [(k, 20, 19) for k in range(30)]
    assert pdf.pages_of(files.limit(0)).collect() == []


def test_providers_are_given_bounded_batches(spark):
    rows = spark.range(1000).coalesce(1).select("id", F.concat(F.lit("t"), "id").alias("prompt"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    told = providers.complete(rows, lambda given: [f"{p} of {len(given)}" for p in given]).collect()
    assert [r.reply.split(" ")[0] for r in told] == [f"t{k}" for k in range(1000)] and max(int(r.reply.split(" ")[-1]) for r in told) <= providers.BATCH
    made = providers.embed_each(rows, lambda given: [[float(x), len(given)] for x in given], dim=2).collect()
    assert [(r.embedding[0] if r.embedding else None, r.error) for r in made] == [(k, None) if k % 3 else (None, "no text") for k in range(1000)]
    assert max(r.embedding[1] for r in made if r.embedding) <= providers.BATCH


def test_a_ledger_does_not_shuffle_prompts_for_replies(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "id long, prompt string")
    asked = ledger.ask(rows, lambda given: [p.upper() for p in given], str(tmp_path / "kept"), "m").select("id", "reply", "error")
    assert sorted(asked.collect()) == [(1, "A", None), (2, None, "no prompt"), (3, "A", None), (4, "B", None)]

    def joined(node):
        kids = [node.children().apply(k) for k in range(node.children().size())]
        return ([k.output().mkString(" ") for k in kids] if node.nodeName() == "Join" else []) + [x for k in kids for x in joined(k)]

    assert joined(asked._jdf.queryExecution().optimizedPlan()) and not any("prompt#" in x for x in joined(asked._jdf.queryExecution().optimizedPlan()))
