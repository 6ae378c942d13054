"""guestlens: review analytics for many places at once, as Spark jobs.

Raw review pages are landed as files, normalised into a review table, selected,
ordered and cut into chronological batches, analysed (sentiment, aspects,
themes, trends, priorities), tree-combined, stored with upserts and served by
lookup, status and expiry jobs.  Every step is a DataFrame / SQL job; the only
Python that runs on executors is the optional user-supplied analyzer callable
(``operators.model_calls``) and nothing else.
"""

__version__ = "0.1.0"
