"""Print the formatted physical plan of registered queries.

    python tools/explain_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexigen.plans import catalog as C  # noqa: E402
from lexigen.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or sorted(C.all_queries())
    spark = local_session(8)
    for name in names:
        print(f"===== {name}")
        C.all_queries()[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
