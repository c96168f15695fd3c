"""Readers and writers; every path may be any URI that Spark reads (s3a://, file://, hdfs://)."""
