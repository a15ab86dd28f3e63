"""pairfeat: short-text pair features as Spark DataFrame jobs.

A pair table ``(qid, ql, qr, label)`` goes in; similarity features come out as
columns. Every family is a projection over the pair rows (no shuffle) except the
corpus-fitted vectors and sentence vectors, which aggregate by term or by pair.
"""

from pairfeat.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
