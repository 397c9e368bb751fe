"""kappaflow: essay-scoring data jobs on Spark.

Essay tables with two human raters are checked, cut into sentences, embedded
in distributed batches, regrouped per essay, scored per trait and compared
with the raters (accuracy, quadratic weighted kappa, MAE, RMSE ...), all as
DataFrame / Spark SQL / Spark ML jobs with explicit keys instead of row order.
"""

__version__ = "0.1.0"
