"""seqlens: Spark operators for ordered, multi-part media and text collections."""
