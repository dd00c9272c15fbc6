"""Small tables with the awkward rows that every operator must take."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text). The other columns are made up."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA)


def driver_rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


LONG = " ".join(f"w{i % 977} the" for i in range(20000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "A b c"), (6, LONG), (6, LONG), (None, "no id here at all"), (None, None), (9, "é ñ 你好 🙂\n\né ñ 你好 🙂")]
