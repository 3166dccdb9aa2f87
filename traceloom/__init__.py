"""traceloom: control-program verdicts, state traces and corpus pipelines on PySpark."""

__version__ = "0.1.0"
