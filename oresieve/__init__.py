"""A Spark-first engine for mining software repositories from snapshots of search results, metadata, trees and files."""
