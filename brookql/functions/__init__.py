"""The function catalogue: importing this package registers all functions."""

from brookql.functions import arrays, conversions, datetimes, encodings, mathematics, strings  # noqa: F401
from brookql.functions.values import FUNCTIONS, declare

AGGREGATES = tuple("avg collect count last_value latest lead max median merge_agg min percentile percentile_cont percentile_disc stddev stddevs sum var vars last_agg_hit_count last_agg_hit_time".split())
ANALYTIC = tuple("acc_avg acc_count acc_map_agg acc_max acc_max_by acc_min acc_min_by acc_sum changed_col had_changed lag changed_cols acc_collect acc_distinct_collect distinct_acc sequence_match sequence_count row_number last_hit_count last_hit_time".split())
WIDENING = ("unnest", "extract", "changed_cols")

declare("avg collect count median merge_agg max min stddev stddevs sum var vars", 1, 1, "aggregate")
declare("last_value latest", 1, 2, "aggregate")
declare("lead", 1, 4, "aggregate")
declare("percentile percentile_cont percentile_disc", 2, 2, "aggregate")
declare("row_number last_agg_hit_count last_agg_hit_time", 0, 0, "aggregate")
declare("acc_avg acc_count acc_max acc_min acc_sum acc_collect acc_distinct_collect distinct_acc", 1, 1, "analytic")
declare("acc_map_agg acc_max_by acc_min_by", 2, 2, "analytic")
declare("changed_col had_changed", 1, None, "analytic")
declare("lag", 1, 4, "analytic")
declare("changed_cols", 2, None, "analytic")
declare("sequence_match sequence_count", 3, None, "analytic")
declare("last_hit_count last_hit_time", 0, 0, "system")
declare("unnest extract", 1, 1, "conversions")

__all__ = ["AGGREGATES", "ANALYTIC", "FUNCTIONS", "WIDENING"]
