"""Tables of transcripts, requests, samples and media."""
