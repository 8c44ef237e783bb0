"""spark-submit entry of the batch audit: run_audit.py <listings.csv or .parquet> <output folder>"""
import sys

from sparkaudit.job import main

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
