"""DataFrame operators. Each module holds one family; none of them imports ``triscope.llm``."""
