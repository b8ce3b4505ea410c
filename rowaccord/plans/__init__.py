"""End-to-end comparisons and the reports made from them."""
