"""Security scanning of file corpora as Spark jobs.

Files (or file versions, or change events) are tables; rule tables are small
broadcast tables; every engine is a DataFrame -> DataFrame function so that a
single job can scan a whole organisation's code.
"""

from scanforge.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
