"""Driver-table query catalogue (SURVEY Appendix A)."""
