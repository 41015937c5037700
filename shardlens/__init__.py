"""shardlens — find out what is inside an AI training dataset, as Spark jobs.

Open Parquet shards, JSONL, JSON or CSV as one logical dataset and page, search,
inspect, profile and quality-check it over the whole data.
"""

from .session import get_spark, work_dir
from .sources.dataset import Dataset, DatasetError, open_dataset

__all__ = ["Dataset", "DatasetError", "get_spark", "open_dataset", "work_dir"]
