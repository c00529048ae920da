"""varietylens: hierarchical text-variety analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers (delimited, lines, XML, JSON, file-name columns) and sinks
functions  column expressions (tokenisation, char streams, label composition)
operators  DataFrame -> DataFrame operators (cleaning, windows, standardisation,
           split, n-grams, TF-IDF, Kneser-Ney LMs, naive Bayes, metrics)
plans      end-to-end jobs (fixture corpus, fit / apply / evaluate, layers)
streaming  Structured Streaming prediction over a fitted model
"""

__version__ = "0.1.0"
