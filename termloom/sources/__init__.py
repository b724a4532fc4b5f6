from termloom.sources.csf_text import CsfText, read_csf_text
from termloom.sources.header import find_header_file, header_lines_of, peel_tokens, read_peel_subshells, write_header
from termloom.sources.parquet_info import get_parquet_info

__all__ = ["CsfText", "find_header_file", "get_parquet_info", "header_lines_of", "peel_tokens", "read_csf_text", "read_peel_subshells", "write_header"]
