"""rankflow: link ranking and run telemetry as Spark DataFrame plans.

Main entry points (all DataFrame in, DataFrame out unless noted):

* graph input: ``sources.text.parse_edges`` / ``parse_adjacency_tsv`` /
  ``parse_vertex_json``; ``operators.graph`` for vertices, degrees, adjacency
* ranking: ``plans.loop.rank_until`` / ``rank_fixed`` (returns a
  ``RankResult`` with ranks, history and status), ``plans.loop.prepare`` +
  ``run`` to reuse a prepared graph, ``operators.vertex_program``
* telemetry: ``sources.logs.read_log_lines`` / ``parse_job_log`` /
  ``parse_sar`` and ``operators.telemetry.job_metrics``
* statistics: ``operators.benchstats``
* sinks: ``sinks``
"""

from .plans.loop import RankResult, prepare, rank_fixed, rank_until, run  # noqa: F401
from .session import ensure_checkpoint_dir, local_session  # noqa: F401
