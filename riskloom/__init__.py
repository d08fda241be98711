"""Credit-risk modelling and scorecard analytics on Spark DataFrames."""

from riskloom.functions.metrics import auc, brier_score, calibration_curve, calibration_slope_intercept, cohens_d, cumulative_gains, delong_test, ece, gini, ks, lift_table, log_loss, psi
from riskloom.operators.binning import BinningResult, categorical, manual, monotonic, tree_bins
from riskloom.operators.terms import binned, bs, cross, hinge, interact, ns, poly, smooth, step, woe
from riskloom.plans.assume import check_assumptions
from riskloom.plans.inspect import binning_table, coefficients, diagnostics, hat_matrix, influence
from riskloom.plans.keyed_reports import figures_by_segment, figures_over_time
from riskloom.plans.reports import compare, performance, performance_by_segment, performance_over_time, report_by_segment, report_over_time
from riskloom.plans.solve import AssumptionError, SegmentedSolution, Solution, predict, register, solve
from riskloom.plans.splits import expanding_window, purged_kfold, rolling_window, time_split
from riskloom.plans.validate import best_mean, bootstrap, cross_validate, lambda_path, log_grid, nested_cv, one_se_rule, over_time, tune
from riskloom.spec import LinearSpec, SegmentedSpec, fit_binnings, linear, segmented
from riskloom.values import NoPenalty, l1, l2, logistic, squared_error

__version__ = "0.1.0"
__all__ = [n for n in dir() if not n.startswith("_") and n not in ("functions", "operators", "plans", "sources", "spec", "values")]
