"""statweave: statistical questions over Spark DataFrames."""
from statweave.spec import Spec

__all__ = ["Spec"]
