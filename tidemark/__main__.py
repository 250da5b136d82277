"""X-11: python -m tidemark NAME TABLES [OUT]: runs a query of the catalogue over a folder of tables; without arguments, lists them."""

import sys

from tidemark.queries import QUERIES
from tidemark.session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print(__doc__, *sorted(QUERIES), sep="\n")
        return 0 if not args else 2
    df = QUERIES[args[0]](session(), args[1])
    if len(args) > 2:
        df.write.mode("overwrite").parquet(args[2])
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
