"""Operations of a training-data pipeline: quality, deduplication, packing, privacy.

Every operator takes and returns DataFrames, reads only the columns that it is
told about, and leaves no state outside the folder in ``spark.checkpoint.dir``.
"""
