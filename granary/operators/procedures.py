"""Selectable procedures as table functions, and blocks as SQL scripts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


class Squares:
    """Suspends a row for each number up to n."""

    def eval(self, n: int) -> Iterator[tuple[int, int]]:
        for i in range(1, (n or 0) + 1):
            yield i, i * i


def register(spark: SparkSession) -> None:
    """Make the procedures available to SQL."""
    spark.udtf.register("granary_squares", udtf(Squares, returnType="n int, square int"))


def script(spark: SparkSession, text: str) -> DataFrame:
    """Run a BEGIN ... END script; gives its last query's rows."""
    return spark.sql(text)


def collatz(spark: SparkSession, start: int) -> DataFrame:
    """Steps and peak of a sequence, by a loop with variables."""
    return script(
        spark,
        f"""
        BEGIN
          DECLARE x BIGINT DEFAULT {int(start)};
          DECLARE peak BIGINT DEFAULT {int(start)};
          DECLARE steps INT DEFAULT 0;
          WHILE x <> 1 DO
            IF x % 2 = 0 THEN SET x = x div 2; ELSE SET x = 3 * x + 1; END IF;
            IF x > peak THEN SET peak = x; END IF;
            SET steps = steps + 1;
          END WHILE;
          SELECT steps AS steps, peak AS peak;
        END""",
    )


def call(spark: SparkSession, inputs: str, values: tuple, outputs: str, body: str) -> DataFrame:
    """EXECUTE PROCEDURE: body over variables for inputs ("name TYPE, ...", set to values) and outputs; gives one row of outputs."""
    names = [x.split()[0] for x in outputs.split(",")]
    given = "".join(f"DECLARE {x.strip()} DEFAULT {_literal(v)}; " for x, v in zip(inputs.split(","), values, strict=True))
    made = "".join(f"DECLARE {x.strip()}; " for x in outputs.split(","))
    return script(spark, f"BEGIN {given}{made}{body} SELECT {', '.join(f'{n} AS {n}' for n in names)}; END")


def _literal(value: object) -> str:
    if value is None or isinstance(value, bool):
        return str(value).replace("None", "NULL").lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)
