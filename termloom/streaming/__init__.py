from termloom.streaming.describe import describe_stream

__all__ = ["describe_stream"]
