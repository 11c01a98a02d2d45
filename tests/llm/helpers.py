from __future__ import annotations

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside; they must not get in the way.
CLASHING = ["n", "m", "size", "node", "score", "ids", "keys", "probability", "_done", "_k0", "data", "topic", "kept", "tag", "root", "component"]


def docs(spark, texts: dict, clash: bool = True):
    df = spark.createDataFrame([(k, t, "en", "s", len(t) if t else None) for k, t in texts.items()], DOC)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


#: Nulls, empty and white texts, long words, ties and text with all kinds of characters.
ODD = {
    1: None, 2: "", 3: " ", 4: "a", 5: "a", 6: "A\tb\r\nc", 7: "x" * 3000, 8: "word " * 900, 9: "word " * 900, 10: "é ü ñ 漢字 🙂     ~ </s>",
    11: "'s don't <|endoftext|> 123 456", 12: "\x00\x01 low", 13: "   lead  and trail   ", 14: "idiot scum", 15: "!!" * 50,
}
