"""Analytics over large collections of agent transcripts, written as Spark DataFrame jobs."""
