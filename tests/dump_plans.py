"""Write the physical plans of the headline queries (sf0.01) as markdown: python tests/dump_plans.py > PLANS.md"""

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["fragments", "hash_embed", "semantic_search", "similarity_stats", "vector_topn", "pack_documents",
         "select_examples", "cache_hits", "diff_hunks", "summarize_changes"]


def main():
    from textlake.plans import registry
    from textlake.session import local_session

    spark = local_session()
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tests/dump_plans.py` at `{sf_dir}` (local mode, AQE on; the plans are the initial ones,",
           "before AQE's runtime changes). Steps that ran while the plan was built (written tables under the",
           "checkpoint folder: packing items, embedded fragments, picks) show up as parquet scans.", ""]
    for name in NAMES:
        df = registry.QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = "\n".join(line for line in buf.getvalue().splitlines() if line.strip())
        plan = plan.replace(os.path.dirname(sf_dir.rstrip("/")), "<testdata>")
        out += [f"## {name}", "", "```", plan, "```", ""]
    print("\n".join(out))


if __name__ == "__main__":
    main()
