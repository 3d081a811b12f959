"""Commands: ``python -m folioscope index LINES INDEX`` and ``python -m folioscope search INDEX QUERY``.

``index`` makes the index of text files, a line a document. ``search`` prints docid and score of each hit, best first. A wrong call
ends with 1, an index or text that cannot be read with 2.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import corpus, index, search
from folioscope.sources.files import numbered_file_lines


def index_files(spark: SparkSession, lines: str, path: str) -> str:
    """Writes the index of text files to ``path`` and says of how many documents."""
    own = corpus.corpus_lines(numbered_file_lines(spark, lines))
    index.Index.build(own).write(path)
    return f"indexed docs: {index.Index.read(spark, path).docs.count()}"


def found_lines(spark: SparkSession, path: str, query: str) -> DataFrame:
    return search.as_lines(search.search_path(spark, path, query))


def main(arguments: list[str], spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    if len(arguments) != 3 or arguments[0] not in ("index", "search"):
        print(__doc__, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("folioscope").getOrCreate()
    command, path, last = arguments
    try:
        if command == "index":
            say(index_files(spark, path, last))
        else:
            for row in found_lines(spark, path, last).toLocalIterator():
                say(row.line)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        print(f"cannot read {path}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
