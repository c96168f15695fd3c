"""lariat: recruiting-funnel analytics and candidate ranking as Spark plans."""
