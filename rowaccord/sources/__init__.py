"""Reading text files of unknown layout, and folders of workbooks. Other sources are Spark's own."""
