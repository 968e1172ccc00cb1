"""Write PLANS.md: the physical plan tree of each headline query plus its scan details.

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from bench import HEADLINE, TIMED as QUERIES  # noqa: E402
from clickweave.config import build_session  # noqa: E402
from clickweave.plans.registry import catalog_for  # noqa: E402


def _summary(formatted: str) -> str:
    tree = formatted.split("\n\n")[0]
    scans = []
    for block in formatted.split("\n\n"):
        if re.match(r"\(\d+\) Scan", block.strip()):
            keep = [ln for ln in block.splitlines()
                    if ln.startswith(("(", "PushedFilters", "PartitionFilters", "ReadSchema"))]
            scans.append("\n".join(keep))
    return tree + ("\n\n" + "\n\n".join(scans) if scans else "")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    catalog_for(spark, sf_dir).clean()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` at `{sf_dir}` (AQE initial plans; the clean and raw "
           "tables are the persisted month-partitioned parquet tables).", ""]
    # rfm's plan starts at its checkpoint; rfm_raw shows the event-side part
    for name in [*HEADLINE, "rfm_raw", "eda_duplicate_drilldown", "check_electronics_clean"]:
        df = QUERIES[name](spark, sf_dir)
        formatted = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        n_ex = len(re.findall(r"\bExchange \(", formatted.split("\n\n")[0]))
        out += [f"## {name}  ({n_ex} exchanges)", "", "```", _summary(formatted).strip(), "```", ""]
    (ROOT / "PLANS.md").write_text("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
