"""The jobs as queries over whole tables, and the SQL that their output must agree with. Each runs its job twice into one
new folder of the shared folder, which stays, and returns the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import digest_sheets, library_intake
from ringspan import oracles as O
from ringspan.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_library_intake(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "library_intake")
    # a pattern, so that it may be a file or a folder
    for _ in range(2):
        out = library_intake.run(spark, f"{d}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint")
    return out


def job2_digest_sheets(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "digest_sheets")
    for _ in range(2):
        out = digest_sheets.run(spark, f"{d}/documents.parquet", f"{at}/out")
    return out


QUERIES = {f.__name__: f for f in (job1_library_intake, job2_digest_sheets)}

SQL = {
    "job1_library_intake": O._with(O.SEQS, O.LONG) + f"SELECT id, source, CAST(length(s) AS INTEGER) AS length, round({O._GC.format(s='s')}, 6) AS gc, fingerprint, min(id) OVER (PARTITION BY fingerprint) AS first_id, CASE WHEN id = min(id) OVER (PARTITION BY fingerprint) THEN 'first' ELSE 'copy' END AS status FROM prints JOIN seqs USING (id) JOIN documents ON doc_id = id",
    "job2_digest_sheets": O._with(O.ENZ, O.COND, O.SEQS, O.CUTS, O._LOOK) + "SELECT id, cuts.enzyme, top, sold_as, CAST(temp_c AS VARCHAR) AS temp_c, CAST(minutes AS VARCHAR) AS minutes, inactivation, source FROM cuts JOIN look ON look.enzyme = cuts.enzyme JOIN documents ON doc_id = id WHERE n_cuts = 1",
}
