"""op6 and op8 against their SQL on planted rows: title and copyright lines, wrapped texts, null turns."""

import os
import sys
import tempfile
import textwrap

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from oracle_check import compare  # noqa: E402

from textlake.llm import registry as R  # noqa: E402
from textlake.llm.license_scan import KNOWN  # noqa: E402


def both(spark, name, table, rows, schema):
    """Rows of a query, after checking them against its SQL on the same planted table."""
    folder = tempfile.mkdtemp(prefix="textlake-planted-")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    got = R.QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    assert compare(got, con.execute(R.ORACLE[name]).df()) is None
    return got


def test_license_sql_is_the_operators_rule(spark):
    whole = {i: t for i, t in KNOWN if i in ("MIT", "ISC") and len(t) > 300}
    texts = []
    for name, text in whole.items():
        wrapped = textwrap.fill(text, 70)
        for title in ("", f"{name} License\n\n", f"The {name} License ({name})\r\n", f"{name} Licence:\n", f"{name} License"):
            for notice in ("", "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n", "© Somebody\n", "(c) <year> X\r\n",
                           "Copyright: [yyyy] Name\r", "copyright notice holders unite\n"):
                texts += [title + notice + t for t in (text, wrapped, wrapped.replace("\n", "\r\n").upper())]
    texts += ["", None, "MIT License", "MIT License\n", "\n MIT License \n \n", "copyright", "Copyright 1999", "All rights reserved.",
              "all rights reserved to all", "SPDX-License-Identifier: MIT\nCopyright holders\nLicensed under CC BY 4.0.",
              "Released under the MIT Licence\r\n\rReleased under the MIT License.", "x " * 60_000 + "\nSPDX-License-Identifier: MIT"]
    got = both(spark, "op6_license_scan", "documents", [(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert got["whole_text_license"].notna().sum() >= 2 * 3 * 4 * 5


def test_null_turns_come_last(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, None, "assistant", "late"),
            (2, None, "assistant", "only"), (3, 0, "assistant", "x"), (3, None, "user", "no answer follows"),
            (4, 0, "user", None), (4, 1, "assistant", None), (4, 2, None, "hm"), (4, 3, "assistant", "y"),
            (5, 0, "user", "none answers"), (None, 1, "assistant", "z"), (6, 0, "assistant", "s"), (6, 1, "assistant", "s")]
    got = both(spark, "op8_chat_format", "conversations", rows, "conv_id long, turn int, role string, text string")
    by = {r.pair_id: r for r in got.itertuples()}
    assert set(by) == {1, 2, 3, 4, 6}
    assert by[1].chosen == "<|assistant|>\nlate<|end|>\n" and by[1].rejected == "<|assistant|>\na<|end|>\n"
    assert by[1].n_prefix == 2 and by[2].chosen == "<|assistant|>\nonly<|end|>\n" and by[3].n_prefix == 0
    assert by[6].chosen == "" and by[6].n_prefix == 2
