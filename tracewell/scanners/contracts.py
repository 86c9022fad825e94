"""Contract drift, a channel each, over symbols and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.references import first_of_each

#: The layers that are run from the command line, names that many files have, and names that are bound to a contract.
LAYERS = ("experiments", "audit", "verify")
COMMON_NAMES = ("main", "parse_args", "require", "close", "count")
SENSITIVE_NAMES = ("build_score_components", "evaluate_provider", "intervention_providers", "load_model", "matrix_provider", "parity_check")


def env_written_not_read(facts: DataFrame) -> DataFrame:
    """(value, path, line): the first write of each variable that nothing reads."""
    writes = facts.where("kind = 'env_write'").select("value", "path", "line")
    return first_of_each(writes.join(facts.where("kind = 'env_read'").select("value").distinct(), "value", "left_anti"), ["value"], ["path", "line"])


def generation_path_without_env(facts: DataFrame) -> DataFrame:
    """(value, path, line): literals that name a generation, in files that read no variable."""
    return facts.where("kind = 'generation'").join(facts.where("kind = 'env_read'").select("path").distinct(), "path", "left_anti").select("value", "path", "line").distinct()


def defensive_param_loosening(facts: DataFrame) -> DataFrame:
    """(value, path, line, kind): state loaded without strictness, or files loaded with more than weights."""
    return facts.where("kind IN ('strict_false', 'weights_only_false')").select("value", "path", "line", "kind")


def forwarding_wrappers(symbols: DataFrame) -> DataFrame:
    """(path, qualname, target, passes_varargs, passes_kwargs): functions that only return a call, and whether it is given * or **."""
    return symbols.where("forwards_to IS NOT NULL").select("path", "qualname", F.col("forwards_to").alias("target"), "passes_varargs", "passes_kwargs")


def same_name(symbols: DataFrame, sensitive: tuple[str, ...] = SENSITIVE_NAMES) -> DataFrame:
    """(name, paths): top-level functions of one name in two files or more, if the name is sensitive or one file is in lib; not the common names."""
    own = symbols.where("enclosing = 'module'").where(~F.col("name").isin(*COMMON_NAMES)).groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return own.where((F.size("paths") >= 2) & (F.col("name").isin(*sensitive) | F.exists("paths", lambda p: p.startswith("lib/"))))


def unreferenced(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, qualname): functions whose name is loaded nowhere; not those of tests, nor of names that Python or a test runner calls."""
    own = symbols.where("enclosing IN ('module', 'class') AND NOT startswith(name, '__') AND NOT startswith(name, 'test_') AND NOT startswith(path, 'tests/')")
    return own.join(facts.where("kind = 'load'").select(F.col("value").alias("name")).distinct(), "name", "left_anti").select("path", "qualname")


def cli_without_bootstrap(facts: DataFrame) -> DataFrame:
    """(path): files of the layers that have a main guard and put nothing on sys.path."""
    own = facts.groupBy("path").agg(F.bool_or(F.col("kind") == "main_guard").alias("m"), F.bool_or(F.col("kind") == "sys_path").alias("s"))
    return own.where(F.col("m") & ~F.col("s") & F.split("path", "/")[0].isin(*LAYERS)).select("path")


def experiment_as_library(facts: DataFrame) -> DataFrame:
    """(path, value, line): imports of an experiment from outside the experiments."""
    return facts.where("kind = 'import' AND (value = 'experiments' OR value LIKE 'experiments.%') AND NOT path LIKE 'experiments/%' AND NOT path LIKE 'tests/%'").select("path", "value", "line").distinct()


def experiment_path_hacks(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'sys_path' AND path LIKE 'experiments/%'").select("path", "value", "line")


def dynamic_module_runtime_coupling(couplings: DataFrame) -> DataFrame:
    """(path, line, kind, priority, loads, module_bindings, rebindings, state_attributes): a row for each file that loads modules while it runs. Setting
    attributes of these modules makes it high: what they are set to is state that no signature shows."""
    return couplings.withColumn("mutates", F.size("rebindings") > 0).select(
        "path",
        F.array_min(F.transform("loads", lambda x: x["line"])).alias("line"),
        F.when(F.col("mutates"), "dynamic_module_state_mutation").otherwise("dynamic_module_load").alias("kind"),
        F.when(F.col("mutates"), "high").otherwise("medium").alias("priority"),
        F.array_sort("loads").alias("loads"), "module_bindings", F.array_sort("rebindings").alias("rebindings"),
        F.array_sort(F.array_distinct(F.transform("rebindings", lambda x: x["attribute"]))).alias("state_attributes"),
    )
