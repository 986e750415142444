"""Rows with everything that tables may hold: nulls, empty and long texts, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, fp string, copy int, n_words string, text_crc32 string, label string"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with the jolly gnome"


def awkward(spark):
    long_text = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
    texts = {
        0: SENTENCE,
        1: SENTENCE,
        2: SENTENCE.replace("lazy", "idle"),
        3: "",
        4: None,
        5: " \t\n ",
        6: long_text,
        7: long_text[:-8],
        8: "Ünïcode ÀÉÎ 好的 🙂 ﬁn x",
        9: "x" * 5000,
        10: "one",
        11: "# $ % & | < > *",
        12: "line one is here\nline one is here\nother line",
        20_000: "far away in the numbers a document stands alone and says nothing new at all",
        1 << 45: "farther still " * 4,
    }
    rows = [(i, t, "en", None if i == 2 else f"src{i % 3}", None if t is None else len(t), 1, "x", "y", 2, "z", "c", "l") for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, "no id here", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return awkward(spark).limit(0)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.where(F.col("doc_id").isNotNull()).collect()}


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.where(F.col("doc_id").isNotNull()).collect()}
