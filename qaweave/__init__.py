"""Spark jobs that build, clean, align and measure a multilingual QA corpus."""
