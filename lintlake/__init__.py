"""lintlake: audits of large corpora of source files, pages and documents as Spark jobs."""
