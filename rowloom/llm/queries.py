"""The operators as queries over whole tables: (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .block_distribution import op1_block_distribution
from .covering_simhash import op8_covering_simhash
from .license_templates import op3_license_templates
from .line_frequency import OP5_SQL, op5_line_frequency
from .poisson_mix import OP2_SQL, op2_poisson_mix
from .prefix_bpe import op9_prefix_bpe
from .repair_codec import op7_repair_codec
from .splitters import op10_sampled_splitters
from .syncmers import op4_closed_syncmers
from .url_rules import op6_url_rules


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_block_distribution": _over("pages", op1_block_distribution),
        "op2_poisson_mix": _over("documents", op2_poisson_mix),
        "op3_license_templates": _over("documents", op3_license_templates),
        "op4_closed_syncmers": _over("documents", op4_closed_syncmers),
        "op5_line_frequency": _over("documents", op5_line_frequency),
        "op6_url_rules": _over("pages", op6_url_rules),
        "op7_repair_codec": _over("documents", op7_repair_codec),
        "op8_covering_simhash": _over("documents", op8_covering_simhash),
        "op9_prefix_bpe": _over("documents", op9_prefix_bpe),
        "op10_sampled_splitters": _over("documents", op10_sampled_splitters),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_poisson_mix": OP2_SQL, "op5_line_frequency": OP5_SQL}
