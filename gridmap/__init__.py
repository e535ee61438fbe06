"""gridmap: map loosely structured spreadsheets to business fields with Spark.

The package is organised by role:

* ``sources``    - readers that turn files / tables into the long ``cells`` and
                   ``lines`` tables (CSV text, workbooks, XML, HTML, JSON labels).
* ``functions``  - Column-expression helpers (cell formatting, text rules,
                   parsing).  Everything here is a built-in Spark expression.
* ``operators``  - DataFrame -> DataFrame building blocks (header detection,
                   section extraction, conflict resolution, vocabulary,
                   evaluation, prompt rows, ...).
* ``plans``      - end-to-end jobs wired from operators, plus the query set
                   used for verification and benchmarking.
* ``streaming``  - the same batch job run on files as they arrive.
"""

from gridmap.session import get_spark, checkpoint_root

__all__ = ["get_spark", "checkpoint_root"]
