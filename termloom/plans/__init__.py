from termloom.plans.convert import convert_csfs, convert_frame
from termloom.plans.describe import describe_frame, generate_descriptors_from_parquet

__all__ = ["convert_csfs", "convert_frame", "describe_frame", "generate_descriptors_from_parquet"]
